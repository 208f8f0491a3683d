"""Queries: small functions, collators, evaluation, conversion, and what any SQL engine offers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquarry.functions import misc
from geoquarry.operators import collate, encode, evaluate
from geoquarry.plans import sql as sql_front
from geoquarry.plans.q_mixing import u_sql
from geoquarry.plans.q_streams import through_stream
from geoquarry.plans.queries import query
from geoquarry.plans.views import BOXES, boxes
from geoquarry.sources import convert
from geoquarry.streaming import streams
from geoquarry.tables import table

# Functions


@query("SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN NULL ELSE 'image/png' END AS kind, CASE WHEN rec_id % 3 = 0 THEN NULL ELSE md5(coalesce(question, '')) END AS data FROM vqa_records")
def media_uri(spark: SparkSession, d: str) -> DataFrame:
    data = F.base64(F.coalesce("question", F.lit("")).cast("binary"))
    uri = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("http://x/"), data)).otherwise(F.concat(F.lit("data:image/png;base64,"), data))
    rows = table(spark, d, "vqa_records").select("rec_id", F.regexp_replace(uri, r"\s", "").alias("u"))
    kind, content = misc.media_uri(F.col("u"))
    return rows.select("rec_id", kind.alias("kind"), F.md5(content).alias("data"))


@query(r"SELECT rec_id, regexp_replace(question, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS name FROM vqa_records")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vqa_records").select("rec_id", misc.clean_name(F.col("question")).alias("name"))


@query("""SELECT doc_id, md5(text) || '_g1_gd8_s56' AS long_key, substr(md5(text), 1, 8) || '_g0_gd8_s28' AS short_key,
 'media_inputs_v1|1|56|' || n_chars || 'x7:' || substr(md5(text), 1, 16) || ',' || '3x4:' || substr(md5(source), 1, 16) || '|0|1' AS media_key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and source is not null")
    image = lambda w, h, data: F.struct(w.alias("width"), h.alias("height"), data.cast("binary").alias("data"))
    images = F.array(image(F.col("n_chars"), F.lit(7), F.col("text")), image(F.lit(3), F.lit(4), F.col("source")))
    key = misc.media_key(images, F.array().cast("array<string>"), F.array(F.lit("a")), True, 56)
    return rows.select("doc_id", misc.content_key(F.col("text").cast("binary"), True, 56).alias("long_key"), misc.content_key(F.col("text").cast("binary"), False, 28, digits=8).alias("short_key"), key.alias("media_key"))


@query("""SELECT o_orderkey, CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.0fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS text FROM (SELECT o_orderkey, CAST(power(7, o_orderkey % 13) AS BIGINT) AS n FROM orders)""")
def human_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", misc.human_count(F.pow(F.lit(7), F.col("o_orderkey") % 13).cast("bigint")).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 9 IN (6, 8) THEN 480 ELSE 640 END AS w, CASE WHEN event_id % 9 IN (6, 8) THEN 640 ELSE 480 END AS h, strftime(ts, '%d %b %Y') AS day, (event_id % 86400) // 3600 || ':' || lpad((((event_id % 86400) % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS clock FROM events")
def sizes_and_dates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    w, h = misc.upright_size(F.lit(640), F.lit(480), F.when(i % 9 > 0, i % 9))
    return table(spark, d, "events").select("event_id", w.alias("w"), h.alias("h"), misc.prompt_date(F.col("ts")).alias("day"), misc.elapsed(i % 86400).alias("clock"))


@query("SELECT doc_id, right(text, 200) AS tail FROM documents")
def log_tails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", misc.log_tail(F.col("text"), 200).alias("tail"))


@query("SELECT event_type AS step, coalesce(avg(CASE WHEN event_id % 5 > 0 THEN value END), 0.0) * 1000 AS time_ms, count(CASE WHEN event_id % 5 > 0 THEN value END) AS runs FROM events GROUP BY event_type")
def profile_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("step"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("seconds"))
    return evaluate.profile(rows, "step", "seconds")


# Evaluation


@query("""WITH e AS (SELECT rec_id, coalesce(type, 'any') AS s, question, ground_truth, answer FROM vqa_records WHERE question IS NOT NULL AND ground_truth IS NOT NULL),
p AS (SELECT *, question || chr(10) || 'A. ' || ground_truth || CASE WHEN answer IS NOT NULL THEN chr(10) || 'B. ' || answer ELSE '' END || chr(10) || 'C. none' || chr(10) || 'Answer:' AS prompt FROM e)
SELECT rec_id, 'user=The following are multiple choice questions (with answers) about ' || s || '.' || chr(10) || chr(10) || 'Is it so?' || chr(10) || 'Answer:|assistant=A|user=' || prompt || '|assistant=A' AS text FROM p""")
def choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.eval_template("en")
    rows = table(spark, d, "vqa_records").where("question is not null and ground_truth is not null")
    prompt = evaluate.choice_prompt(t, F.col("question"), {"A": F.col("ground_truth"), "B": F.col("answer"), "C": F.lit("none")})
    shots = F.array(F.struct(evaluate.choice_prompt(t, F.lit("Is it so?"), {}).alias("prompt"), F.lit("A").alias("answer")))
    turns = evaluate.eval_messages(t, F.coalesce("type", F.lit("any")), shots, prompt, F.lit("A"))
    return rows.select("rec_id", F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("text"))


@query("""WITH r AS (SELECT coalesce(dataset, 'none') AS category, CASE WHEN ground_truth = answer THEN 1.0 ELSE 0.0 END AS c FROM vqa_records)
SELECT category, printf('%15s: %.2f', category, 100 * avg(c)) AS line FROM r GROUP BY category UNION ALL SELECT 'Average', printf('%15s: %.2f', 'Average', 100 * avg(c)) FROM r""")
def score_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").select(F.coalesce("dataset", F.lit("none")).alias("category"), F.coalesce(F.col("ground_truth") == F.col("answer"), F.lit(False)).alias("correct"))
    return evaluate.score_lines(rows, "category", "correct")


@query("SELECT rec_id, length(question) + 1 AS score FROM vqa_records WHERE question IS NOT NULL")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model that plugs in, here one that counts characters."""
    rows = table(spark, d, "vqa_records").where("question is not null").select("rec_id", "question")
    return evaluate.score(rows, lambda: (lambda batch: batch["question"].str.len() + 1), "score", "bigint").select("rec_id", "score")


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL")
def batched_lines(spark: SparkSession, d: str) -> DataFrame:
    def split(columns: dict[str, list]) -> dict[str, list]:
        pairs = [(i, line) for i, text in zip(columns["doc_id"], columns["text"]) for line in text.split("\n")]
        return {"doc_id": [i for i, _ in pairs], "line": [x for _, x in pairs]}

    return evaluate.batched(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), split, "doc_id bigint, line string")


# Collators


_IDS = "list_transform(range({0}), lambda k: CAST(({1} + k) % 50 + 1 AS INTEGER))"


@query(f"""WITH n AS (SELECT ann_id, (row_number() OVER (ORDER BY ann_id) - 1) // 4 AS batch, CAST(ann_id % 9 + 1 AS INTEGER) AS n, CASE WHEN ann_id % 3 = 0 THEN 1 ELSE 0 END AS media FROM annotations),
d AS (SELECT *, CASE WHEN max(media) OVER (PARTITION BY batch) = 0 AND row_number() OVER (PARTITION BY batch ORDER BY ann_id) = 1 THEN 2 ELSE 0 END AS x FROM n),
l AS (SELECT *, CAST(ceil(max(n + x) OVER (PARTITION BY batch) / 8.0) * 8 AS INTEGER) AS l FROM d)
SELECT ann_id, list_concat({_IDS.format("n", "ann_id")}, CASE WHEN x > 0 THEN [98, 99] ELSE [] END, list_transform(range(l - n - x), lambda k: 0)) AS input_ids,
 list_concat(list_transform(range(n), lambda k: CAST(k AS INTEGER)), list_transform(range(l - n), lambda k: -100)) AS labels,
 list_concat(list_transform(range(n), lambda k: 1), list_transform(range(l - n), lambda k: 0)) AS attention_mask,
 list_concat(list_transform(range(n), lambda k: CAST(k AS INTEGER)), list_transform(range(l - n), lambda k: 1)) AS positions FROM l""")
def multimodal_batches(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("ann_id"), (F.col("ann_id") % 9 + 1).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda k: ((i + k) % 50 + 1).cast("int"))
    rows = encode.batches(table(spark, d, "annotations").select("ann_id", ids.alias("input_ids"), F.sequence(F.lit(0), n - 1).alias("labels")), "ann_id", 4)
    return collate.multimodal_batch(rows, "batch_id", "ann_id", F.when(i % 3 == 0, 1).otherwise(0), [98, 99]).select("ann_id", "input_ids", "labels", "attention_mask", "positions")


@query(f"""WITH n AS (SELECT ann_id, (row_number() OVER (ORDER BY ann_id) - 1) // 4 AS batch, CAST(ann_id % 9 + 1 AS INTEGER) AS n, CAST(ann_id % 4 + 2 AS INTEGER) AS k FROM annotations),
l AS (SELECT *, max(n) OVER (PARTITION BY batch) AS a, max(k) OVER (PARTITION BY batch) AS b FROM n)
SELECT ann_id, ann_id % 2 = 0 AS tag, list_concat({_IDS.format("n", "ann_id")}, list_transform(range(a - n), lambda k: 0)) AS input_ids, list_concat({_IDS.format("k", "ann_id + 1")}, list_transform(range(b - k), lambda x: 0)) AS kl_input_ids,
 list_concat(list_transform(range(k), lambda x: 1), list_transform(range(b - k), lambda x: 0)) AS kl_attention_mask FROM l""")
def feedback_batches(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("ann_id")
    ids = lambda n, add: F.transform(F.sequence(F.lit(0), n - 1), lambda k: ((i + add + k) % 50 + 1).cast("int"))
    own, other = ids((i % 9 + 1).cast("int"), 0), ids((i % 4 + 2).cast("int"), 1)
    rows = table(spark, d, "annotations").select("ann_id", (i % 2 == 0).alias("tag"), own.alias("input_ids"), own.alias("labels"), other.alias("kl_input_ids"), other.alias("kl_labels"))
    return collate.feedback_batch(encode.batches(rows, "ann_id", 4), "batch_id").select("ann_id", "tag", "input_ids", "kl_input_ids", "kl_attention_mask")


@query("""SELECT ann_id, list_concat([5], CASE WHEN n > 0 THEN list_transform(range(n + 1), lambda k: 7) ELSE [] END, [6, 8]) AS ids FROM (SELECT ann_id, CAST(ann_id % 4 AS INTEGER) AS n FROM annotations)""")
def media_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run of n media tokens is rebuilt to n + 1; a text without any stays."""
    n = (F.col("ann_id") % 4).cast("int")
    ids = F.concat(F.array(F.lit(5)), F.array_repeat(F.lit(7), n), F.array(F.lit(6), F.lit(8)))
    return table(spark, d, "annotations").select("ann_id", collate.media_run(ids, 7, n + 1).alias("ids"))


@query("SELECT ann_id, CASE WHEN ann_id % 3 = 1 THEN 'no video input' WHEN ann_id % 5 = 1 THEN 'no audio input' END AS error FROM annotations")
def modality_errors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("ann_id")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "annotations").select("ann_id", collate.modality_error(some(i % 2 == 0), some(i % 3 == 1), some(i % 5 == 1), {"image"}).alias("error"))


@query(f"""WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS c FROM eval_items),
p AS (SELECT item_id, unnest([1, 2, 3]) AS rank FROM eval_items)
SELECT p.item_id, p.rank, n.item_id AS partner FROM p JOIN n ON n.k = CAST(floor({u_sql(9, "p.item_id || ':' || p.rank")} * (SELECT count(*) FROM eval_items)) AS BIGINT)""")
def mosaic_partners(spark: SparkSession, d: str) -> DataFrame:
    return collate.partners(table(spark, d, "eval_items").select("item_id"), "item_id", 3, 9)


@query(f"WITH {BOXES} SELECT image_id, box_id FROM boxes WHERE (x2 - x1) * (y2 - y1) > 600")
def without_empty_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes shrunk by a fixed area; those left without any are dropped."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - 600
    return boxes(spark, d).withColumn("area", area).where("area > 0").select("image_id", "box_id")


@query("SELECT item_id, 'a' AS part FROM eval_items WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'b' FROM eval_items WHERE item_id % 3 = 0")
def stacked_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lists of columns set under each other, then chosen by a flag."""
    items = table(spark, d, "eval_items").select("item_id")
    parts = items.select("item_id", F.lit("a").alias("part"), (F.col("item_id") % 2 == 0).alias("keep")).unionByName(items.select("item_id", F.lit("b").alias("part"), (F.col("item_id") % 3 == 0).alias("keep")))
    return evaluate.chain(parts, [lambda t: t.where("keep"), lambda t: t.drop("keep")])


# Conversion


@query("""SELECT rec_id, CAST(rec_id % 5 AS INTEGER) - 1 AS cls, (rec_id % 100 + 20 / 2.0) / 640 AS cx, (rec_id % 50 + 10 / 2.0) / 480 AS cy, 20 / 640.0 AS w, 10 / 480.0 AS h FROM vqa_records WHERE rec_id % 4 > 0""")
def drone_labels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("rec_id")
    line = F.concat_ws(",", i % 100, i % 50, F.lit(20), F.lit(10), i % 4, i % 5, F.lit(0), F.lit(0))
    return convert.drone_labels(table(spark, d, "vqa_records").select("rec_id", line.alias("value"), F.lit(640).alias("iw"), F.lit(480).alias("ih")), "iw", "ih")


@query("""SELECT rec_id, '3 ' || g(rec_id % 16 / 16.0) || ' ' || g((rec_id % 8) * 2000) || ' ' || g(rec_id % 4 / 4.0) || ' 0.5' AS line FROM (SELECT rec_id FROM vqa_records)""".replace("g(", "printf('%g', 1.0::DOUBLE * "))
def polygon_lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("rec_id")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(i % 16 * 40.0, i % 8 * 800000.0), point(i % 4 * 160.0, F.lit(200.0)))
    return table(spark, d, "vqa_records").select("rec_id", convert.polygon_line(F.lit(3), points, F.lit(640.0), F.lit(400.0)).alias("line"))


@query("""SELECT rec_id, CAST(rec_id % 2 AS INTEGER) AS cls, ((rec_id % 90 + 1 + rec_id % 90 + 11) / 2.0 - 1) / 500 AS cx, ((5 + 25) / 2.0 - 1) / 400 AS cy, 10 / 500.0 AS w, 20 / 400.0 AS h FROM vqa_records WHERE rec_id % 3 < 2 AND rec_id % 7 > 0""")
def voc_labels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("rec_id")
    name = F.when(i % 3 == 2, "tree").when(i % 2 == 0, "ship").otherwise("plane")
    xml = F.format_string("<annotation><size><width>500</width><height>400</height></size><object><name>%s</name><difficult>%d</difficult><bndbox><xmin>%d</xmin><ymin>5</ymin><xmax>%d</xmax><ymax>25</ymax></bndbox></object></annotation>", name, F.when(i % 7 == 0, 1).otherwise(0), i % 90 + 1, i % 90 + 11)
    return convert.voc_labels(table(spark, d, "vqa_records").select("rec_id", xml.alias("xml")), "xml", ["ship", "plane"])


@query("SELECT DISTINCT '/data/' || image_id AS path FROM vqa_records WHERE image_id IS NOT NULL AND image_id <> '' AND NOT starts_with(image_id, '/') UNION SELECT image_id FROM vqa_records WHERE starts_with(image_id, '/') UNION SELECT '/data/' || 'x' || (rec_id % 10) FROM vqa_records")
def image_path_scan(spark: SparkSession, d: str) -> DataFrame:
    """Paths of JSON lines, a list in some and one path in others, with broken lines between them."""
    i = F.col("rec_id")
    one = F.to_json(F.struct(F.col("image_id").alias("images")))
    many = F.to_json(F.struct(F.array(F.concat(F.lit("x"), (i % 10).cast("string"))).alias("images")))
    rows = table(spark, d, "vqa_records")
    lines = rows.select(one.alias("value")).unionByName(rows.select(many.alias("value"))).unionByName(rows.select(F.concat(F.lit('{"images": '), i.cast("string"), F.lit(", broken")).alias("value")))
    return convert.image_paths(lines, "images", "/data")[0]


# What SQL engines offer


@query("SELECT kind, count(*) AS n, count(*) FILTER (normal <> '') AS worded FROM (SELECT kind, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normal FROM documents) GROUP BY kind")
def sql_views(spark: SparkSession, d: str) -> DataFrame:
    """The tables as views and the engine's functions, from SQL text."""
    sql_front.register(spark, d)
    return spark.sql("SELECT kind, count(*) AS n, count_if(normal_form(text) <> '') AS worded FROM documents GROUP BY kind")


@query(f"""WITH {BOXES}, o AS (SELECT d.image_id, d.det_id, g.gt_id FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls = g.cls AND d.x1 = g.x1 AND d.y1 = g.y1)
SELECT coalesce(d.image_id, g.image_id) AS image_id, d.det_id, g.gt_id FROM (SELECT det.image_id, det.det_id, o.gt_id AS m FROM det LEFT JOIN o USING (image_id, det_id)) d FULL JOIN gt g ON d.image_id = g.image_id AND d.m = g.gt_id""")
def full_outer_match(spark: SparkSession, d: str) -> DataFrame:
    """Detections and true boxes side by side; background on either side is null."""
    from geoquarry.plans.views import detections, truths

    det, gt = detections(spark, d), truths(spark, d)
    corner = ["image_id", "cls", "x1", "y1"]
    pairs = det.select(*corner, "det_id").join(gt.select(*corner, "gt_id"), corner).select("image_id", "det_id", F.col("gt_id").alias("m"))
    left = det.select("image_id", "det_id").join(pairs, ["image_id", "det_id"], "left")
    right = gt.select(F.col("image_id").alias("_i"), "gt_id")
    return left.join(right, (F.col("image_id") == F.col("_i")) & (F.col("m") == F.col("gt_id")), "full_outer").select(F.coalesce("image_id", "_i").alias("image_id"), "det_id", "gt_id")


@query("""SELECT image_id AS image, 'both' AS part FROM (SELECT image_id FROM vqa_records INTERSECT SELECT image FROM annotations) UNION ALL
SELECT image_id, 'records' FROM (SELECT image_id FROM vqa_records EXCEPT ALL SELECT image FROM annotations)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "vqa_records").select(F.col("image_id").alias("image")), table(spark, d, "annotations").select("image")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).withColumn("part", F.lit("records")))


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY ALL""")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.sliding(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT max(ts) AS top FROM events) SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events, m WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= top - INTERVAL '2 hours' GROUP BY ALL""")
def ext_late_data(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a stream that a watermark has closed; late rows of closed windows are dropped."""
    rows = table(spark, d, "events").select("event_type", "ts", "value")
    out = through_stream(spark, rows, lambda s: streams.tumbling(s, "ts", ["event_type"], "1 hour", "value", "2 hours"), "append", "late")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT o_orderpriority AS p, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS total, max(o_orderdate) - INTERVAL '3 months' AS before, count(*) AS n FROM orders GROUP BY 1""")
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """Decimals, intervals and maps as they are."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    made = rows.select("p", F.create_map(F.lit("total"), F.col("total")).alias("m"), (F.col("last") - F.expr("INTERVAL 3 MONTHS")).alias("before"), "n")
    return made.select("p", F.col("m")["total"].alias("total"), F.col("before").cast("timestamp_ntz").alias("before"), "n")


@query("SELECT dataset, coalesce(type, 'all') AS type, n FROM (SELECT coalesce(dataset, '-') AS dataset, type, count(*) AS n FROM (SELECT dataset, coalesce(type, '-') AS type FROM vqa_records) GROUP BY CUBE (dataset, type)) WHERE type IS NOT NULL OR dataset <> '-'")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").select("dataset", F.coalesce("type", F.lit("-")).alias("type"))
    counted = rows.cube("dataset", "type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("dataset", F.lit("-")).alias("dataset"), "type", "n")
    return counted.where((F.col("type").isNotNull()) | (F.col("dataset") != "-")).select("dataset", F.coalesce("type", F.lit("all")).alias("type"), "n")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Whether an approximate count of users lies within a tenth of the exact one."""
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count_distinct("user_id")) <= F.count_distinct("user_id") * 0.1
    return table(spark, d, "events").groupBy("event_type").agg(near.alias("near"))


@query("SELECT user_id, event_id, arg_max(b, bt) AS before FROM (SELECT e.user_id, e.event_id, o.event_id AS b, o.ts AS bt FROM events e JOIN events o ON o.user_id = e.user_id AND o.event_type = 'click' AND o.ts < e.ts WHERE e.event_type = 'purchase') GROUP BY ALL")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the last click before it: one pass over the user's time line."""
    rows = table(spark, d, "events").where("user_id is not null and event_type in ('click', 'purchase')")
    line = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    click = F.col("event_type") == "click"
    before = F.max_by(F.when(click, F.col("event_id")), F.when(click, F.col("ts"))).over(line)
    return rows.withColumn("before", before).where("event_type = 'purchase' and before is not null").select("user_id", "event_id", "before")


# Media


_MEDIA = """m AS (SELECT ann_id, CAST(ann_id % 3 + 1 AS INTEGER) AS t, CAST(ann_id % 4 + 1 AS INTEGER) * 2 AS h, CAST(ann_id % 5 + 1 AS INTEGER) * 2 AS w, CAST(ann_id % 4 + 2 AS INTEGER) * 28 AS height, CAST(ann_id % 3 + 2 AS INTEGER) * 28 AS width,
 CAST(ann_id % 7 + 3 AS INTEGER) AS features, CAST(ann_id % 2 + 1 AS INTEGER) AS tiles, CAST(ann_id % 50 + 9 AS INTEGER) AS frames FROM annotations),
c AS (SELECT *, t * h * w // 4 AS n, h * w // 4 AS f, (height // 14) * (width // 14) AS p FROM m)"""
_V = "'<|vision_start|>' || repeat('{0}', CAST({1} AS BIGINT)) || '<|vision_end|>'"
_TIMES = "list_transform(range(t), lambda k: {0})"
_PIECES = {
    ("gemma3", "image"): "chr(10) || chr(10) || '<start_of_image>' || repeat('<image>', 3) || '<end_of_image>' || chr(10) || chr(10)",
    ("gemma3n", "audio"): "chr(10) || chr(10) || '<start_of_audio>' || repeat('<audio>', 3) || '<end_of_audio>' || chr(10) || chr(10)",
    ("glm4v", "image"): "'<|begin_of_image|>' || repeat('<image>', n) || '<|end_of_image|>'",
    ("glm4v", "video"): "'<|begin_of_video|>' || array_to_string(" + _TIMES.format("'<|begin_of_image|>' || repeat('<image>', f) || '<|end_of_image|>' || (k * 2)") + ", '') || '<|end_of_video|>'",
    ("intern_vl", "image"): "'<img>' || repeat('<IMG_CONTEXT>', tiles * 3) || '</img>'",
    ("intern_vl", "video"): "array_to_string(" + _TIMES.format("'Frame' || (k + 1) || ': <img>' || repeat('<IMG_CONTEXT>', 3) || '</img>'") + ", chr(10))",
    ("kimi_vl", "image"): "'<|media_start|>image<|media_content|>' || repeat('<image>', n) || '<|media_end|>'",
    ("llama4", "image"): "'<|image_start|>' || CASE WHEN h * w > 1 THEN repeat(repeat('<|patch|>', p) || repeat('<|tile_x_separator|>' || repeat('<|patch|>', p), w - 1) || '<|tile_y_separator|>', h) ELSE '' END || '<|image|>' || repeat('<|patch|>', p) || '<|image_end|>'",
    ("llava", "image"): "repeat('<image>', p)",
    ("llava_next", "image"): "repeat('<image>', features - 1)",
    ("llava_next_video", "video"): "repeat('<video>', p // 4 * t)",
    ("minicpm_v", "image"): "'(<image>./</image>)'",
    ("minicpm_v", "video"): "repeat('(<image>./</image>)', t)",
    ("minicpm_v", "audio"): "'(<audio>./</audio>)'",
    ("mllama", "image"): "'<image>'",
    ("paligemma", "image"): "''",
    ("pixtral", "image"): "left(repeat(repeat('<image>', width // 28) || '[IMG_BREAK]', height // 28), -11) || '[IMG_END]'",
    ("qwen2_audio", "audio"): "'<|audio_bos|>' || repeat('<audio>', ((frames - 1) // 2 - 1) // 2 + 1) || '<|audio_eos|>'",
    ("qwen2_vl", "image"): "CASE WHEN ann_id % 2 = 0 THEN " + _V.format("<image>", "1") + " || " + _V.format("<image>", "n - 1") + " ELSE " + _V.format("<image>", "n") + " END",
    ("qwen2_vl", "video"): _V.format("<video>", "n"),
    ("qwen3_vl", "video"): "array_to_string(" + _TIMES.format("'<' || (k * 2) || '.0 seconds>' || " + _V.format("<video>", "f")) + ", '')",
    ("qwen2_omni", "image"): _V.format("<image>", "n"),
    ("video_llava", "video"): "repeat('<video>', (p + 1) * t)",
}


@query(f"WITH {_MEDIA} " + " UNION ALL ".join(f"SELECT ann_id, '{p}' AS plugin, '{k}' AS kind, 'a ' || {sql} || ' b <{k}>' AS text FROM c" for (p, k), sql in _PIECES.items()))
def media_plugins(spark: SparkSession, d: str) -> DataFrame:
    """One medium and two marks in every plugin: the first mark is expanded, the second stays."""
    from functools import reduce

    from geoquarry.operators import media

    i = F.col("ann_id")
    size = lambda n, low, by: ((i % n + low) * by).cast("int")
    t = size(3, 1, 1)
    n = F.floor(t * size(4, 1, 2) * size(5, 1, 2) / 4).cast("int")
    one = F.struct(t.alias("t"), size(4, 1, 2).alias("h"), size(5, 1, 2).alias("w"), size(4, 2, 28).alias("height"), size(3, 2, 28).alias("width"), size(7, 3, 1).alias("features"), size(2, 1, 1).alias("tiles"), size(50, 9, 1).alias("frames"),
                   F.transform(F.sequence(F.lit(0), t - 1), lambda k: k * 2.0).alias("times"), F.array_repeat(F.lit(1), t).alias("patches"), F.when(i % 2 == 0, 1).alias("global_n"), (n - 1).alias("semantic_n"))
    rows = table(spark, d, "annotations").select("ann_id", F.array(one).alias("m"))
    parts = []
    for plugin, kind in _PIECES:
        rule = media.rules(plugin, sizes=media.Sizes(tokens=3))[kind]
        parts.append(rows.select("ann_id", F.lit(plugin).alias("plugin"), F.lit(kind).alias("kind"), media.expand(F.lit(f"a <{kind}> b <{kind}>"), kind, F.col("m"), rule).alias("text")))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT ann_id, list_concat(list_transform(range(2 * (ann_id % 3)), lambda k: 9), [1, 2]) AS ids, list_concat(list_transform(range(2 * (ann_id % 3)), lambda k: -100), [1, 2]) AS labels FROM annotations")
def prefixed_media(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.operators import media

    images = F.array_repeat(F.lit("x"), (F.col("ann_id") % 3).cast("int"))
    ids, labels = media.prefixed_ids(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), 9, images, 2)
    return table(spark, d, "annotations").select("ann_id", ids.alias("ids"), labels.alias("labels"))
