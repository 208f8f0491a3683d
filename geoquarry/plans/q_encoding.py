"""Queries: token budgets, rows for training, packing, masks, chunks, placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.operators import align as A
from geoquarry.operators import encode as E
from geoquarry.operators import tokens as K
from geoquarry.plans.q_align import aligned
from geoquarry.plans.queries import query
from geoquarry.plans.views import DIALOGUES
from geoquarry.tables import table

CUTOFF = 48
_IDS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'), lambda w: CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 50000 AS INTEGER))"


def _budget(s: str, t: str, c: str) -> tuple[str, str]:
    most = f"CASE WHEN {t} * 2 < {c} THEN {c} WHEN {s} * 2 < {c} THEN {c} - {s} ELSE CAST(floor({c} * ({t}::DOUBLE / nullif({s} + {t}, 0))) AS BIGINT) END"
    kept = f"least({most}, {t})"
    return f"least(greatest({c} - ({kept}), 0), {s})", f"({kept})"


_LENGTHS = f"""l AS (SELECT rec_id, len({_IDS.format("question")}) AS s, len({_IDS.format("answer")}) AS t FROM vqa_records)"""


@query(f"WITH {_LENGTHS} SELECT rec_id, {_budget('s', 't', '12')[0]} AS source_len, {_budget('s', 't', '12')[1]} AS target_len FROM l")
def len_budget_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records")
    s, t = E.budget(F.size(E.token_ids(F.col("question"))), F.size(E.token_ids(F.col("answer"))), 12)
    return rows.select("rec_id", s.alias("source_len"), t.alias("target_len"))


_TURNS = f"""e AS (SELECT ann_id, unnest(range(len(turns) // 2)) AS i, turns FROM roled WHERE valid),
p AS (SELECT ann_id, i, {_IDS.format("turns[i * 2 + 1].content")} AS s, {_IDS.format("turns[i * 2 + 2].content")} AS t FROM e)"""


def _fold(order: str, history: bool) -> str:
    """The running budget as a recursive table over the turns in an order."""
    n_s, n_t = _budget("len(n.s)", "len(n.t)", f"({CUTOFF} - r.used)")
    labels = f"list_concat(list_transform(range(({n_s})), lambda x: -100), " + (f"CASE WHEN n.o = 0 THEN n.t[1:{n_t}] ELSE list_transform(range(({n_t})), lambda x: -100) END)" if history else f"n.t[1:{n_t}])")
    ids = f"list_concat(n.s[1:{n_s}], n.t[1:{n_t}])"
    join = (lambda old, new: f"list_concat({new}, {old})") if history else (lambda old, new: f"list_concat({old}, {new})")
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY i {order}) - 1 AS o, count(*) OVER (PARTITION BY ann_id) AS c FROM p),
r(ann_id, o, c, used, ids, labels) AS (
  SELECT DISTINCT ann_id, CAST(-1 AS BIGINT), c, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM o
  UNION ALL
  SELECT r.ann_id, n.o, r.c, r.used + CASE WHEN {CUTOFF} - r.used <= 0 THEN 0 ELSE ({n_s}) + ({n_t}) END,
    CASE WHEN {CUTOFF} - r.used <= 0 THEN r.ids ELSE {join("r.ids", ids)} END, CASE WHEN {CUTOFF} - r.used <= 0 THEN r.labels ELSE {join("r.labels", labels)} END
  FROM r JOIN o n ON n.ann_id = r.ann_id AND n.o = r.o + 1)"""


@query(f"WITH RECURSIVE {DIALOGUES}, {_TURNS}, {_fold('', False)} SELECT ann_id, len(ids) AS n, array_to_string(ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels FROM r WHERE o = c - 1")
def sft_label_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = E.sft_rows(aligned(spark, d), "ann_id", CUTOFF)
    return rows.select("ann_id", F.size("input_ids").alias("n"), F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query(f"WITH RECURSIVE {DIALOGUES}, {_TURNS}, {_fold('DESC', True)} SELECT ann_id, array_to_string(labels, ' ') AS labels FROM r WHERE o = c - 1")
def mask_history(spark: SparkSession, d: str) -> DataFrame:
    rows = E.sft_rows(aligned(spark, d), "ann_id", CUTOFF, mask_history=True)
    return rows.select("ann_id", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


_PAIR = f"""w AS (SELECT rec_id, {_IDS.format("question")} AS p, list_concat({_IDS.format("ground_truth")}, [1]) AS c, list_concat({_IDS.format("answer")}, [1]) AS r FROM vqa_records),
v AS (SELECT *, {_budget('len(p)', 'greatest(len(c), len(r))', '20')[0]} AS ns, {_budget('len(p)', 'greatest(len(c), len(r))', '20')[1]} AS nt FROM w)"""


@query(f"WITH {_PAIR} SELECT rec_id, array_to_string(list_concat(p[1:ns], c[1:nt]), ' ') AS chosen, array_to_string(list_concat(p[1:ns], r[1:nt]), ' ') AS rejected, ns AS masked FROM v")
def pairwise_encode(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: E.token_ids(F.col(c))
    out = E.pairwise(ids("question"), ids("ground_truth"), ids("answer"), 20)
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return table(spark, d, "vqa_records").select("rec_id", text(out["chosen_input_ids"]).alias("chosen"), text(out["rejected_input_ids"]).alias("rejected"), F.size(F.filter(out["chosen_labels"], lambda x: x == E.IGNORE)).alias("masked"))


@query(f"""WITH t AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS b, list_concat({_IDS.format("text")}, [1]) AS ids FROM documents),
f AS (SELECT b, doc_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS id FROM t), n AS (SELECT b, id, row_number() OVER (PARTITION BY b ORDER BY doc_id, i) - 1 AS k FROM f)
SELECT b AS batch_id, k // 256 AS block, array_to_string(list(id ORDER BY k), ' ') AS input_ids FROM n GROUP BY b, k // 256 HAVING count(*) = 256""")
def pretrain_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = E.batches(table(spark, d, "documents").select("doc_id", F.concat(E.token_ids(F.col("text")), F.array(F.lit(1))).alias("ids")), "doc_id")
    chunks = E.pretrain_chunks(rows, "batch_id", "doc_id", "ids", 256)
    return chunks.select("batch_id", "block", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return E.pack(E.batches(E.sft_rows(aligned(spark, d), "ann_id", CUTOFF), "ann_id"), "batch_id", "ann_id", 128)


@query()
def pack_knapsack(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d).select("batch_id", "pack", "keys", F.size("input_ids").alias("n"))


@query(f"""WITH RECURSIVE {DIALOGUES}, {_TURNS}, {_fold('', False)}, q AS (SELECT ann_id, len(ids) AS n FROM r WHERE o = c - 1), b AS (SELECT (row_number() OVER (ORDER BY ann_id) - 1) // 1000 AS batch_id, n FROM q)
SELECT batch_id, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, true AS fits FROM b GROUP BY batch_id""")
def pack_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every row is in one pack, with all its tokens, and every pack has the same length."""
    packs = _packs(spark, d)
    used = F.size(F.filter("attention_mask", lambda m: m > 0))
    return packs.groupBy("batch_id").agg(F.sum(F.size("keys")).alias("rows"), F.sum(used).alias("tokens"), ((F.min(F.size("input_ids")) == 129) & (F.max(F.size("input_ids")) == 129)).alias("fits"))


_MASK = """m AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 4) AS INTEGER) + 3) AS raw FROM embeddings),
k AS (SELECT vec_id, list_sort(raw) AS mask FROM m)"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    raw = F.transform(F.col("embedding").cast("array<double>"), lambda v: (F.floor(v * 4) + 3).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.array_sort(raw).alias("mask"))


@query(f"""WITH {_MASK}, l AS (SELECT vec_id, list_transform(list_sort(list_distinct(list_filter(mask, lambda x: x <> 0))), lambda s: len(list_filter(mask, lambda x: x = s))) AS n FROM k)
SELECT vec_id, array_to_string(n, ' ') AS lengths, array_to_string(list_concat([0], list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::INTEGER)), ' ') AS offsets FROM l""")
def cu_seqlens(spark: SparkSession, d: str) -> DataFrame:
    n = E.sequence_lengths(F.col("mask"))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return _masks(spark, d).select("vec_id", text(n).alias("lengths"), text(E.offsets(n)).alias("offsets"))


@query(f"""WITH {_MASK}, e AS (SELECT vec_id, generate_subscripts(mask, 1) - 1 AS i, unnest(mask) AS s FROM k)
SELECT a.vec_id, a.i, b.i AS j FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.s = b.s AND b.i <= a.i AND a.s <> 0""")
def packed_segments_mask(spark: SparkSession, d: str) -> DataFrame:
    return E.block_causal(_masks(spark, d), "vec_id", "mask")


@query("""SELECT doc_id, replace(text, '<image>', '<|vision_start|>' || repeat('<|image_pad|>', CAST(n_chars % 5 AS INTEGER)) || '<|vision_end|>') AS text FROM documents WHERE text IS NOT NULL""")
def placeholder_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    counts = F.array_repeat(F.col("n_chars") % 5, F.greatest(A.placeholders(F.col("text"), "<image>"), F.lit(0)))
    return rows.select("doc_id", E.expand_placeholders(F.col("text"), "<image>", counts, *E.MEDIA_EXPANDERS["qwen2_vl"]).alias("text"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 4) AS INTEGER) AS v FROM embeddings),
g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, v ORDER BY i) AS run FROM e) SELECT vec_id, min(i) AS begin, count(*) AS n FROM g WHERE v = 0 GROUP BY vec_id, run""")
def image_token_runs(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 4).cast("int"))
    runs = table(spark, d, "embeddings").select("vec_id", F.explode(K.runs_of(ids, 0)).alias("r"))
    return runs.select("vec_id", "r.begin", F.col("r.n").alias("n"))


@query("""WITH s AS (SELECT ann_id, len(coalesce(qa_pairs, [])) AS q, length(coalesce(caption, '')) % 4 + 1 AS g FROM annotations),
v AS (SELECT ann_id, q, g, unnest(range(2 * g * 3)) AS i FROM s)
SELECT ann_id, 'v' AS part, i, CAST(q + i // (g * 3) AS INTEGER) AS t, CAST(q + (i % (g * 3)) // 3 AS INTEGER) AS h, CAST(q + i % 3 AS INTEGER) AS w FROM v
UNION ALL SELECT ann_id, 'x', i, i, i, i FROM (SELECT ann_id, CAST(unnest(range(q)) AS INTEGER) AS i FROM s)
UNION ALL SELECT ann_id, 'y', i, b + i, b + i, b + i FROM (SELECT ann_id, CAST(q + greatest(1, g - 1, 2) + 1 AS INTEGER) AS b, CAST(unnest(range(2)) AS INTEGER) AS i FROM s)""")
def vision_positions(spark: SparkSession, d: str) -> DataFrame:
    q, g = F.size(F.coalesce("qa_pairs", F.array())), (F.length(F.coalesce("caption", F.lit(""))) % 4 + 1).cast("int")
    seg = lambda kind, n, t, h, w: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), t.cast("int").alias("t"), h.cast("int").alias("h"), w.cast("int").alias("w"), F.lit(1).alias("step"))
    zero = F.lit(0)
    segments = F.array(seg("text", q, zero, zero, zero), seg("vision", zero, F.lit(2), g, F.lit(3)), seg("text", F.lit(2), zero, zero, zero))
    rows = table(spark, d, "annotations").select("ann_id", q.alias("q"), g.alias("g"), F.posexplode(K.vision_positions(segments)).alias("k", "p"))
    part = F.when(F.col("k") < F.col("q"), "x").when(F.col("k") < F.col("q") + F.col("g") * 6, "v").otherwise("y")
    i = F.col("k") - F.when(part == "x", 0).when(part == "v", F.col("q")).otherwise(F.col("q") + F.col("g") * 6)
    return rows.select("ann_id", part.alias("part"), i.alias("i"), "p.t", "p.h", "p.w")
