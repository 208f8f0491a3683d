"""Queries: round trips of sources and sinks, and the smaller parts of alignment, encoding, geometry, masks, tokens and scores."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import geometry as G
from geoquarry.functions import templates as T
from geoquarry.operators import align as A
from geoquarry.operators import encode as E
from geoquarry.operators import kernels, metrics, mix, quality, regions, tokens
from geoquarry.plans.q_encoding import _IDS, _budget
from geoquarry.plans.q_mixing import u_sql
from geoquarry.plans.q_prompts import MASKS, masks
from geoquarry.plans.queries import query
from geoquarry.plans.views import BOXES, HALVES, RASTER, boxes, detections, halves, raster, texts
from geoquarry.sources import files, registry, sinks
from geoquarry.storage import shared_folder
from geoquarry.streaming import streams, tracking
from geoquarry.tables import table


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT f AS format, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS total FROM eval_items, (SELECT unnest(['csv', 'jsonl', 'json', 'parquet', 'arrow']) AS f) GROUP BY f UNION ALL SELECT 'txt', count(*), CAST(sum(item_id) AS BIGINT) FROM eval_items")
def scan_formats(spark: SparkSession, d: str) -> DataFrame:
    """A table written in every format of the format map and scanned back."""
    rows = table(spark, d, "eval_items").select("item_id", "question")
    base = _folder(spark, "formats")
    rows.coalesce(2).write.option("header", True).option("escape", '"').csv(f"{base}/csv")
    rows.coalesce(2).write.json(f"{base}/jsonl-raw")
    rows.write.parquet(f"{base}/parquet")
    rows.select(F.col("item_id").cast("string").alias("value")).coalesce(1).write.text(f"{base}/txt")
    lines = spark.read.text(f"{base}/jsonl-raw")
    lines.coalesce(1).write.text(f"{base}/jsonl-text")
    array = rows.agg(F.to_json(F.collect_list(F.struct("item_id", "question"))).alias("value"))
    array.write.text(f"{base}/json-text")
    files.rename(spark, f"{base}/jsonl-text", ".txt", ".jsonl")
    files.rename(spark, f"{base}/json-text", ".txt", ".json")
    files.write_arrow(rows, f"{base}/arrow")
    parts = [files.scan(spark, f"{base}/{folder}").select(F.lit(name).alias("format"), F.col("item_id").cast("bigint").alias("i")) for name, folder in (("csv", "csv"), ("jsonl", "jsonl-text"), ("json", "json-text"), ("parquet", "parquet"), ("arrow", "arrow"))]
    parts.append(files.scan(spark, f"{base}/txt").select(F.lit("txt").alias("format"), F.col("text").cast("bigint").alias("i")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total"))


@query(f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN {u_sql(3, 'doc_id')} < 0.2 THEN 'validation' ELSE 'train' END AS split FROM documents) GROUP BY split")
def tokenized_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A prepared data set saved by split and loaded instead of being prepared again."""
    path = _folder(spark, "tokenized")
    assert files.load_tokenized(spark, path) is None
    files.save_tokenized(mix.split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 3), path)
    return files.load_tokenized(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, 'file' AS kind, file_name AS location, formatting, false AS ranking FROM dataset_registry")
def registry_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The registry as a file of entries, read, resolved by name and listed for a stage."""
    rows = table(spark, d, "dataset_registry").select("name", "file_name", "formatting").collect()
    entries = {r["name"]: registry.parse_entry(r["name"], {"file_name": r["file_name"], "formatting": r["formatting"]}) for r in rows}
    chosen = registry.resolve(entries, ", ".join(entries))
    for source in chosen:
        registry.check_stage(source, "sft")
    return registry.catalog(spark, {s.name: s for s in chosen}, "sft").select("name", "kind", "location", "formatting", "ranking")


@query("SELECT question AS prompt, answer AS response, coalesce(type, '') AS system FROM vqa_records")
def registry_columns(spark: SparkSession, d: str) -> DataFrame:
    source = registry.parse_entry("x", {"file_name": "x.parquet", "columns": {"prompt": "question", "response": "answer", "system": "kind"}})
    return registry.mapped(table(spark, d, "vqa_records").withColumn("kind", F.coalesce("type", F.lit(""))), source)


@query("SELECT name || '.png' AS file FROM dataset_registry UNION ALL SELECT name || '.JPG' FROM dataset_registry")
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Image files below a folder, other files left out."""
    base = _folder(spark, "images")
    names = table(spark, d, "dataset_registry").select(F.explode(F.array(*[F.concat("name", F.lit(e)) for e in (".png", ".JPG", ".txt")])).alias("f"))
    names.select(F.col("f").alias("value"), "f").repartition(1).write.partitionBy("f").text(base)
    files.flatten(spark, base, "f")
    return files.image_files(spark, base).select(F.element_at(F.split("path", "/"), -1).alias("file"))


@query(f"WITH {BOXES} SELECT image_id, string_agg(line, '|' ORDER BY line) AS lines FROM (SELECT image_id, cls || ' ' || printf('%g', 1.0::DOUBLE * floor((x1 + x2) / 2)) || ' ' || printf('%g', 1.0::DOUBLE * floor(y1)) || ' 0.5 0.25' AS line FROM (SELECT image_id % 16 AS image_id, cls, x1, x2, y1 FROM det)) GROUP BY image_id")
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Label lines of all detections, written as a folder an image (here sixteen sheets of images) and read back."""
    rows = detections(spark, d).withColumn("image_id", F.col("image_id") % 16)
    line = sinks.label_line(F.col("cls"), F.floor((F.col("x1") + F.col("x2")) / 2), F.floor("y1"), F.lit(0.5), F.lit(0.25))
    base = _folder(spark, "labels")
    sinks.write_labels(rows.select("image_id", line.alias("line")), base, "image_id", "line")
    back = spark.read.text(base)
    return back.groupBy(F.col("image_id").cast("bigint").alias("image_id")).agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("lines"))


@query("SELECT 'json' AS kind, rec_id, question AS prompt, answer AS predict, ground_truth AS label FROM vqa_records UNION ALL SELECT 'csv', rec_id, NULL, NULL, NULL FROM vqa_records UNION ALL SELECT 'scores', NULL, NULL, printf('%.2f', round(rec_id / 8.0, 2)), printf('%.2f', round(rec_id / 4.0, 2)) FROM vqa_records")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, a plain table and scores through their sinks and back."""
    rows = table(spark, d, "vqa_records")
    base = _folder(spark, "results")
    sinks.write_predictions(rows.select(F.col("question").alias("prompt"), F.to_json(F.struct("answer", "rec_id")).alias("predict"), F.col("ground_truth").alias("label")), f"{base}/p")
    sinks.write_table(rows, f"{base}/t", ["rec_id", "split"])
    sinks.write_scores(rows.select((F.col("rec_id") / 8).alias("chosen"), (F.col("rec_id") / 4).alias("rejected")), f"{base}/s")
    back = spark.read.schema("prompt string, predict string, label string").json(f"{base}/p")
    p = back.select(F.lit("json").alias("kind"), F.get_json_object("predict", "$.rec_id").cast("bigint").alias("rec_id"), "prompt", F.get_json_object("predict", "$.answer").alias("predict"), "label")
    none = F.lit(None).cast("string")
    c = spark.read.option("header", True).csv(f"{base}/t/csv").select(F.lit("csv").alias("kind"), F.col("rec_id").cast("bigint").alias("rec_id"), none.alias("prompt"), none.alias("predict"), none.alias("label"))
    s = spark.read.schema("chosen double, rejected double").json(f"{base}/s").select(F.lit("scores").alias("kind"), F.lit(None).cast("bigint").alias("rec_id"), none.alias("prompt"), F.format_string("%.2f", "chosen").alias("predict"), F.format_string("%.2f", "rejected").alias("label"))
    return p.unionByName(c).unionByName(s)


@query("SELECT DISTINCT image_id AS cache_key FROM vqa_records WHERE image_id IS NOT NULL")
def cache_insert(spark: SparkSession, d: str) -> DataFrame:
    """Entries put into a cache table in two overlapping parts; none is there twice."""
    path = _folder(spark, "cache")
    keys = table(spark, d, "vqa_records").where("image_id is not null").select(F.col("image_id").alias("cache_key"), "rec_id")
    for part in (keys.where("rec_id % 3 < 2"), keys.where("rec_id % 3 > 0"), keys):
        files.insert_missing(part.select("cache_key"), path)
    return files.load_tokenized(spark, path)


@query("SELECT list_concat(list_transform(range(n), lambda k: 5), list_transform(range(m), lambda k: 0)) AS ids, rec_id FROM (SELECT rec_id, CAST(rec_id % 5 AS INTEGER) AS n, CAST(rec_id % 4 AS INTEGER) AS m FROM vqa_records)")
def pads_last(spark: SparkSession, d: str) -> DataFrame:
    n, m = (F.col("rec_id") % 5).cast("int"), (F.col("rec_id") % 4).cast("int")
    return table(spark, d, "vqa_records").select("rec_id", sinks.pads_last(F.concat(F.array_repeat(F.lit(0), m), F.array_repeat(F.lit(5), n)), 0).alias("ids"))


@query(f"WITH {BOXES} SELECT image_id, det_id, '{{\"name\":\"c' || cls || '\",\"class\":' || cls || ',\"box\":{{\"x1\":' || x1 / 64 || ',\"x2\":' || x2 / 64 || '}}}}' AS json FROM det")
def detection_json(spark: SparkSession, d: str) -> DataFrame:
    b = G.box()
    text = sinks.detection_json(F.col("cls"), F.concat(F.lit("c"), F.col("cls").cast("string")), F.col("conf"), *b, F.lit(64.0), F.lit(32.0))
    part = lambda p: F.get_json_object("j", p)
    rows = detections(spark, d).select("image_id", "det_id", text.alias("j"))
    return rows.select("image_id", "det_id", F.concat(F.lit('{"name":"'), part("$.name"), F.lit('","class":'), part("$.class"), F.lit(',"box":{"x1":'), part("$.box.x1"), F.lit(',"x2":'), part("$.box.x2"), F.lit("}}")).alias("json"))


# Alignment


_JOINT = "chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10)"


@query(f"""SELECT rec_id, 'user=' || coalesce(question, '') || '|function=[{{"name":"f"}}]|tool=a' || CASE WHEN rec_id % 2 = 0 THEN {_JOINT} || 'b' ELSE '' END AS prompt, 'assistant=' || coalesce(answer, '') AS response,
 CASE WHEN rec_id % 3 = 0 THEN 'S' || chr(10) || chr(10) || 'detailed thinking off' ELSE '' END AS system FROM vqa_records""")
def align_openai(spark: SparkSession, d: str) -> DataFrame:
    turn = lambda role, text, calls=None: F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(calls).cast("string").alias("tool_calls"))
    i = F.col("rec_id")
    none = F.array().cast("array<struct<role:string,content:string,tool_calls:string>>")
    lead = F.when(i % 3 == 0, F.array(turn("system", F.lit("S")))).otherwise(none)
    results = F.when(i % 2 == 0, F.array(turn("tool", F.lit("a")), turn("tool", F.lit("b")))).otherwise(F.array(turn("tool", F.lit("a"))))
    m = F.concat(lead, F.array(turn("user", F.coalesce("question", F.lit(""))), turn("assistant", F.lit(""), '[{"name":"f"}]')), results, F.array(turn("assistant", F.coalesce("answer", F.lit("")))))
    prompt, response, system = A.converter("openai")(m)
    fixed = lambda c: F.replace(texts(c), F.lit("observation="), F.lit("tool="))
    return table(spark, d, "vqa_records").select("rec_id", fixed(prompt).alias("prompt"), fixed(response).alias("response"), system.alias("system"))


@query(f"WITH {HALVES} SELECT 'kto' AS stage, count(*) AS n FROM halves UNION ALL SELECT 'rm', 0 UNION ALL SELECT 'pt', count(*) FROM halves UNION ALL SELECT 'sft', 0")
def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many aligned rows each stage takes: feedback rows have two responses, so sft takes none of them; ranking is given none."""
    prompt, response = A.alpaca(F.col("prompt"), response=F.col("response"), kto=F.col("tag"))
    rows = halves(spark, d).select("doc_id", prompt.alias("_prompt"), response.alias("_response"))
    out = None
    for stage, part in (("kto", rows), ("rm", rows.where("false")), ("pt", rows), ("sft", rows)):
        one = A.valid(part, stage).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT rec_id, rec_id % 4 = 0 AS path_ok, rec_id % 3 = 0 AS url_ok FROM vqa_records""")
def safe_media(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("rec_id")
    path = F.when(i % 4 == 0, "/data/a/b.png").when(i % 4 == 1, "/data/../etc/x").when(i % 4 == 2, "/database/x").otherwise("a/b")
    url = F.when(i % 3 == 0, "https://example.org/a.png").when(i % 3 == 1, "http://192.168.0.4/a").otherwise("file:///etc/passwd")
    return table(spark, d, "vqa_records").select("rec_id", A.safe_path(path, "/data").alias("path_ok"), A.safe_url(url).alias("url_ok"))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, '<image>', ''))) / 7 AS INTEGER) AS n,
 CASE WHEN (length(text) - length(replace(text, '<image>', ''))) / 7 <> 1 + doc_id % 2 THEN 'image placeholders' END AS reason FROM documents WHERE text IS NOT NULL""")
def placeholders_with_images(spark: SparkSession, d: str) -> DataFrame:
    """Texts with one or two images each: equal counts pass."""
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    images = F.array_repeat(F.lit("x"), (F.col("doc_id") % 2 + 1).cast("int"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", A.placeholders(F.col("text"), "<image>").alias("n"), A.placeholder_check(m, images).alias("reason"))


@query("SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN answer ELSE '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(answer, '') END AS text FROM (SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN '<think>x</think>' || coalesce(answer, '') ELSE coalesce(answer, '') END AS answer FROM vqa_records)")
def empty_thoughts(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("answer", F.lit(""))
    given = F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit("<think>x</think>"), text)).otherwise(text)
    return table(spark, d, "vqa_records").select("rec_id", T.with_empty_thought(given).alias("text"))


# Encoding


def _sides(prefix: str, answer: str) -> str:
    s, t = _budget("len(p)", f"len({answer})", "24")
    return f"list_concat(p[1:{s}], {answer}[1:{t}]) AS {prefix}input_ids, list_concat(list_transform(range(({s})), lambda x: -100), {answer}[1:{t}]) AS {prefix}labels"


@query(f"""WITH e AS (SELECT rec_id, {_IDS.format("question")} AS p, list_concat({_IDS.format("answer")}, [1]) AS a, list_concat({_IDS.format("ground_truth")}, [1]) AS k FROM vqa_records)
SELECT rec_id, rec_id % 2 = 0 AS kto_tags, {_sides("", "a")}, {_sides("kl_", "k")} FROM e""")
def feedback_encode(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: E.token_ids(F.col(c))
    rows = table(spark, d, "vqa_records").select("rec_id", ids("question").alias("p"), ids("answer").alias("a"), ids("ground_truth").alias("k"))
    out = E.feedback(F.col("p"), F.col("a"), F.col("k"), F.col("rec_id") % 2 == 0, 24)
    return rows.select("rec_id", *[c.alias(n) for n, c in out.items()])


@query(f"""WITH e AS (SELECT rec_id, {_IDS.format("question")} AS p, list_concat({_IDS.format("answer")}, [1]) AS a FROM vqa_records)
SELECT rec_id, p[1:{_budget("len(p)", "len(a)", "24")[0]}] AS input_ids, a[1:{_budget("len(p)", "len(a)", "24")[1]}] AS labels FROM e""")
def unsupervised_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").select("rec_id", E.token_ids(F.col("question")).alias("p"), E.token_ids(F.col("answer")).alias("a"))
    out = E.unsupervised(F.col("p"), F.col("a"), 24)
    return rows.select("rec_id", *[c.alias(n) for n, c in out.items()])


@query("""SELECT ann_id, flatten(list_transform([ann_id % 3 + 1, 2, ann_id % 5 + 1], lambda n: list_transform(range(n), lambda k: CAST(k AS INTEGER)))) AS positions,
 list_transform(range(6), lambda k: CASE WHEN (ann_id + k) % 4 = 0 THEN 1 ELSE 0 END) AS types, list_concat([['a']], [['b', 'c'], []]) AS media FROM annotations""")
def batch_pieces(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("ann_id")
    lengths = F.array((i % 3 + 1).cast("int"), F.lit(2), (i % 5 + 1).cast("int"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((i + k) % 4).cast("int"))
    media = E.split_media(F.array(*map(F.lit, "abc")), F.array(F.lit(1), F.lit(2), F.lit(0)))
    return table(spark, d, "annotations").select("ann_id", E.packed_positions(lengths).alias("positions"), E.token_types(ids, 0).alias("types"), media.alias("media"))


# Mixing and splits


@query(f"SELECT split, count(*) AS n, CAST(sum(rec_id) AS BIGINT) AS total FROM (SELECT rec_id, CASE WHEN {u_sql(42, 'rec_id')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM vqa_records) GROUP BY split")
def split_modules(spark: SparkSession, d: str) -> DataFrame:
    """A split table as named tables, counted one by one."""
    parts = mix.modules(mix.split(table(spark, d, "vqa_records").select("rec_id"), "rec_id", 0.1, 42))
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("total")).select(F.lit(name).alias("split"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT rec_id, row_number() OVER (ORDER BY {u_sql(4, 'rec_id')}, rec_id) - 1 AS place FROM vqa_records")
def shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").select("rec_id").withColumn("_at", F.struct(mix.draw(4, "rec_id").alias("u"), "rec_id"))
    return mix.numbered(rows, "_at", "place").select("rec_id", "place")


# Geometry


@query(f"""WITH {BOXES} SELECT image_id, box_id, x1 + (x2 - x1) AS x2_back, (x1 + x2) / 2 AS cx, CAST(ceil((x2 - x1) / 32) * 32 AS INTEGER) AS stride_w,
 CAST(floor((x2 - x1) * (1024.0 / greatest(x2 - x1, y2 - y1)) + 0.5) AS INTEGER) AS long_w, CASE WHEN least(x2 - x1, y2 - y1) < 32 THEN greatest(x2 - x1, 32) ELSE x2 - x1 END AS clamped,
 x1 + 3 AS padded, 96 - y2 AS flipped FROM boxes""")
def box_parts(spark: SparkSession, d: str) -> DataFrame:
    b = G.box()
    w, h = b[2] - b[0], b[3] - b[1]
    back = G.ltwh_to_xyxy(G.xyxy_to_ltwh(b))
    centre = G.ltwh_to_xywh(G.xywh_to_ltwh(G.xyxy_to_xywh(b)))
    return boxes(spark, d).select("image_id", "box_id", back[2].alias("x2_back"), centre[0].alias("cx"), G.divisible(w, 32).alias("stride_w"), G.longest_side(w, h)[0].alias("long_w"), G.aspect_clamp(w, h)[0].cast("double").alias("clamped"), G.pad_box(b, 3, 3)[0].alias("padded"), G.flip_ud(b, F.lit(96.0))[1].alias("flipped"))


@query(f"""WITH {BOXES} SELECT image_id, box_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2, CASE WHEN x1 <= 50 AND y1 <= 40 THEN x1 ELSE 0.0 END AS inside_x1,
 least(greatest((x1 - 0) / 0.5, 0.0), 200.0) AS px, least(greatest((y1 - 14.0) / 0.5, 0.0), 150.0) AS py FROM boxes""")
def segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = G.box()
    points = F.array(F.array(b[0], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    s, inside = G.segment_box(points), G.inside_segment_box(F.array(F.array(b[0], b[1])), 50, 40)
    x, y = G.scale_point(b[0], b[1], (103, 100), (150, 200))
    return boxes(spark, d).select("image_id", "box_id", s["x1"].alias("a1"), s["y1"].alias("b1"), s["x2"].alias("a2"), s["y2"].alias("b2"), inside["x1"].alias("inside_x1"), x.alias("px"), y.alias("py"))


@query("SELECT 0 AS layer, (i + 0.5) / 4 AS x, (j + 0.5) / 4 AS y FROM range(4) a(i), range(4) b(j) UNION ALL SELECT 1, (i + 0.5) / 2, (j + 0.5) / 2 FROM range(2) a(i), range(2) b(j)")
def point_grids(spark: SparkSession, d: str) -> DataFrame:
    grids = tokens.layer_grids(spark, 4, 1, 2)
    return grids.select(F.col("layer").cast("int").alias("layer"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


# Masks in numpy


@query("SELECT o_orderkey, CAST((o_custkey % 9 + 1) * (o_orderkey % 7 + 1) AS BIGINT) AS filled, CAST((o_custkey % 9 + 1) * (o_orderkey % 7 + 1) AS BIGINT) AS decoded, CAST(4 AS BIGINT) AS corners, CAST(12 AS BIGINT) AS resampled FROM orders")
def polygon_masks(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles filled, coded by run lengths and back, outlined and resampled."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 9 + 1).cast("int").alias("w"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("h"))

    def run(batches):
        for batch in batches:
            out, known = [], {}
            for key, w, h in zip(batch["o_orderkey"], batch["w"], batch["h"]):
                got = known.get((w, h))
                if got is None:
                    points = np.array([(1, 1), (1 + w, 1), (1 + w, 1 + h), (1, 1 + h)], float)
                    mask = kernels.polygon_mask(points, 12, 12).astype(bool)
                    back = kernels.from_runs(kernels.run_lengths(mask), 12, 12)
                    edge = kernels.outline(mask)
                    got = known[(w, h)] = (int(mask.sum()), int((back.astype(bool) & mask).sum()), len(edge), len(kernels.resample(points, 12)))
                out.append((key, *got))
            yield pd.DataFrame(out, columns=["o_orderkey", "filled", "decoded", "corners", "resampled"])

    return rows.mapInPandas(run, "o_orderkey bigint, filled bigint, decoded bigint, corners bigint, resampled bigint")


@query(f"WITH {MASKS}, o AS (SELECT image_id, count(*) AS n FROM masks WHERE mask_id = 100 GROUP BY image_id) SELECT image_id, n <= 64 AS fits, true AS grown FROM o")
def mask_holes(spark: SparkSession, d: str) -> DataFrame:
    """Filling small holes never takes a pixel away."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((8, 8), bool)
        mask[p["y"], p["x"]] = True
        filled, _ = kernels.without_small(mask, 4, "holes")
        return pd.DataFrame({"image_id": [p["image_id"].iloc[0]], "fits": [bool(filled.sum() <= 64)], "grown": [bool((filled | ~mask).all() or (filled[mask]).all())]})

    return masks(spark, d).where("mask_id = 100").groupBy("image_id").applyInPandas(run, "image_id bigint, fits boolean, grown boolean")


# Regions and tokens


@query(f"WITH {RASTER} SELECT image_id, label AS region, round(avg(v), 9) AS colour, avg(y) AS cy, avg(x) AS cx FROM raster WHERE label >= 0 GROUP BY ALL")
def region_centres(spark: SparkSession, d: str) -> DataFrame:
    c = regions.centres(raster(spark, d), ["v"])
    return c.select("image_id", "region", F.round("v", 9).alias("colour"), F.col([n for n in c.columns if n.endswith("y")][-1]).alias("cy"), F.col([n for n in c.columns if n.endswith("x")][-1]).alias("cx"))


@query(f"WITH {RASTER} SELECT image_id, y, x, CASE WHEN label >= 0 THEN label // 2 ELSE -1 END AS label FROM raster")
def region_relabel(spark: SparkSession, d: str) -> DataFrame:
    pixels = raster(spark, d)
    lut = pixels.where("label >= 0").select("image_id", F.col("label").alias("region")).distinct().withColumn("merged", F.floor(F.col("region") / 2).cast("int"))
    return regions.relabel(pixels, lut).select("image_id", "y", "x", "label")


_CELL = "CAST(least(greatest(round_even(({0}) * 4095, 0), 0), 4095) AS INTEGER)"


@query(f"""WITH i AS (SELECT ann_id AS image_id, CAST(ann_id % 4 + 1 AS INTEGER) AS r, CAST(ann_id % 3 + 1 AS INTEGER) AS c FROM annotations), t AS (SELECT *, unnest(range(r * c)) AS k FROM i)
SELECT image_id, CAST(k AS INTEGER) AS token_idx, {_CELL.format("(k // c + 0.5) / r")} AS pos_y, {_CELL.format("(k % c + 0.5) / c")} AS pos_x, {_CELL.format("(k // c + 0.5) / r")} AS ext_y FROM t""")
def global_tokens(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "annotations").select(F.col("ann_id").alias("image_id"))
    return tokens.grid_tokens(images, F.col("image_id") % 4 + 1, F.col("image_id") % 3 + 1).select("image_id", "token_idx", "pos_y", "pos_x", "ext_y")


@query("""WITH i AS (SELECT ann_id, unnest(range(6)) AS p FROM annotations) SELECT ann_id AS image_id, p AS pos, CAST(p - 1 AS INTEGER) - 1 AS token_idx FROM i WHERE p >= 2 AND p <= 2 + ann_id % 3""")
def token_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Image tokens at places 1 to 5, one of them global; a descriptor for as many of the rest as there are."""
    notes = table(spark, d, "annotations").select(F.col("ann_id").alias("image_id"))
    ids = notes.select("image_id", F.array(F.lit(5), *[F.lit(7)] * 5).alias("input_ids"))
    described = notes.select("image_id", F.explode(F.sequence(F.lit(0), (F.col("image_id") % 3).cast("int"))).alias("token_idx"))
    return tokens.token_descriptors(ids, described, 7, 1).select("image_id", F.col("pos").cast("bigint").alias("pos"), "token_idx")


@query("SELECT ann_id AS image_id, CASE WHEN ann_id % 3 = 0 THEN 'cache' WHEN ann_id % 2 = 0 THEN 'computed' ELSE 'tiles' END AS provenance, true AS usable FROM annotations")
def token_fallback(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "annotations").select(F.col("ann_id").alias("image_id"))
    grid = lambda rows, kind: tokens.grid_tokens(rows, F.lit(2), F.lit(2), kind)
    found = tokens.with_fallback(grid(images.where("image_id % 2 = 0"), "semantic"), grid(images.where("image_id % 3 = 0"), "global"), grid(images, "tile"))
    usable = tokens.cache_quality(found.drop("provenance")).select("image_id", "usable")
    return found.select("image_id", "provenance").distinct().join(usable, "image_id")


# Scores


@query("SELECT coalesce(type, '-') AS pred, coalesce(question_type, '-') AS \"true\", count(*) AS n FROM vqa_records GROUP BY ALL")
def classification_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").select(F.coalesce("type", F.lit("-")).alias("p"), F.coalesce("question_type", F.lit("-")).alias("t"))
    return metrics.classification_matrix(rows, "p", "t")


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding)), lambda k: CASE WHEN (vec_id + k) % 3 = 0 THEN 0.0 ELSE embedding[k]::DOUBLE END)), 6) AS logp FROM embeddings""")
def sequence_logp(spark: SparkSession, d: str) -> DataFrame:
    labels = F.transform("embedding", lambda _, k: F.when((F.col("vec_id") + k) % 3 == 0, -100).otherwise(7))
    return table(spark, d, "embeddings").select("vec_id", F.round(metrics.sequence_logp(F.col("embedding").cast("array<double>"), labels), 6).alias("logp"))


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL),
h AS (SELECT *, CAST(floor(floor(round_even(n * 0.05 * 2, 0)) / 2) AS BIGINT) AS half FROM e), k AS (SELECT *, unnest(range(-half, half + 1)) AS k FROM h)
SELECT k.user_id, k.event_id, round(sum(e.value) / (2 * any_value(k.half) + 1), 6) AS smooth FROM k JOIN e ON e.user_id = k.user_id AND e.i = least(greatest(k.i + k.k, 1), k.n) GROUP BY ALL""")
def box_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """A curve is one small group: the events of a user."""
    rows = table(spark, d, "events").where("user_id is not null").select("user_id", "event_id", F.col("value").cast("double").alias("value"))
    return metrics.smoothed(rows, ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT count(*) FILTER (WHERE ann_id % 5 = 0) AS missing, count(*) FILTER (WHERE ann_id % 5 > 0) AS found, count(*) FILTER (WHERE ann_id % 5 = 1) AS empty, count(*) FILTER (WHERE ann_id % 7 = 0) AS corrupt FROM annotations")
def label_counters(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "annotations").select(F.col("ann_id").alias("image_id"))
    labels = images.where("image_id % 5 > 0").withColumn("n", F.when(F.col("image_id") % 5 == 1, 0).otherwise(2))
    return quality.image_counters(images, labels, images.where("image_id % 7 = 0"))


@query(f"""WITH i AS (SELECT ann_id AS image_id, CAST(ann_id % 50 + 10 AS DOUBLE) AS w, CAST(ann_id % 70 + 10 AS DOUBLE) AS h FROM annotations), p AS (SELECT * FROM i ORDER BY {u_sql(0, 'image_id')}, image_id LIMIT 30)
SELECT round(avg(w * h * power(640 / greatest(w, h), 2) * 3) * (SELECT count(*) FROM i) * 1.1, 2) AS bytes FROM p""")
def cache_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The thirty images are the operator: an estimate from a sample."""
    i = F.col("ann_id")
    images = table(spark, d, "annotations").select(i.alias("image_id"), (i % 50 + 10).cast("double").alias("width"), (i % 70 + 10).cast("double").alias("height"))
    return quality.ram_estimate(images, 640).select(F.round("bytes", 2).alias("bytes"))


@query("SELECT vec_id, round(exp(-abs(embedding[1]::DOUBLE)) * abs(embedding[1]::DOUBLE), 6) AS loss FROM embeddings")
def confident_loss(spark: SparkSession, d: str) -> DataFrame:
    nll = F.abs(F.col("embedding")[0].cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(metrics.confident_loss(nll), 6).alias("loss"))


@query("SELECT ann_id, ann_id % 2 = 0 AS kept FROM annotations")
def segment_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "annotations").select("ann_id", F.array(F.lit(1), F.lit(2)).alias("boxes"), F.array_repeat(F.lit("s"), (2 + F.col("ann_id") % 2).cast("int")).alias("segments"))
    return quality.without_mismatched_segments(rows, "boxes", "segments").select("ann_id", F.col("segments").isNotNull().alias("kept"))


@query("SELECT version, valid FROM (VALUES ('1', true), ('2', false)) t(version, valid)")
def cache_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest fits its own fingerprint and version, and no other version."""
    paths = table(spark, d, "dataset_registry").select("file_name", F.length("file_name").alias("size"))
    print_ = quality.fingerprint(paths, "file_name", "size")
    manifest = print_.select(F.lit("1").alias("version"), F.col("fingerprint").alias("hash"))
    out = None
    for version in ("1", "2"):
        one = quality.cache_valid(manifest, version, print_).select(F.lit(version).alias("version"), "valid")
        out = one if out is None else out.unionByName(one)
    return out


# Tracks and streams


@query("SELECT user_id AS track_id, 'only' AS part FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)) UNION ALL SELECT user_id, 'joint' FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'purchase'))")
def track_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id is not null")
    of = lambda kind: rows.where(F.col("event_type") == kind).select(F.col("user_id").alias("track_id")).distinct()
    a, b = of("click"), of("purchase")
    return tracking.sub(a, b).withColumn("part", F.lit("only")).unionByName(tracking.joint(a, b).withColumn("part", F.lit("joint")))


@query("SELECT event_id AS removed FROM events ORDER BY event_id DESC LIMIT 999")
def removed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the operator: a list of fixed length."""
    return tracking.removed_kept(table(spark, d, "events").select(F.col("event_id").alias("removed")), "removed")


@query("SELECT event_type, avg(value) AS mean, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY event_type")
def stream_running_mean(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth frame of a stream, and the mean so far."""
    from geoquarry.plans.q_streams import through_stream

    rows = table(spark, d, "events").select("event_type", "event_id", F.col("value").cast("double").alias("value"))
    return through_stream(spark, rows, lambda s: streams.running_mean(streams.strided(s, "event_id", 4), "event_type", "value"), "complete", "mean")


@query(f"SELECT rec_id, CASE WHEN {u_sql(9, 'rec_id')} < 0.25 THEN 'validation' ELSE 'train' END AS split FROM vqa_records")
def stream_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of a stream is that of the table."""
    from geoquarry.plans.q_streams import through_stream

    rows = table(spark, d, "vqa_records").select("rec_id")
    return through_stream(spark, rows, lambda s: mix.split(s, "rec_id", 0.25, 9), "append", "split")
