"""Queries: concatenation, interleaving, sampling, splitting, sharding, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.operators import mix
from geoquarry.plans.queries import query
from geoquarry.sources.files import page
from geoquarry.tables import table


def u_sql(seed: int, key: str) -> str:
    """SQL of ``mix.draw``."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0)"


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("passage").alias("text"))
    notes = table(spark, d, "annotations").select(F.col("ann_id").alias("id"), F.coalesce("caption", F.lit("")).alias("text"))
    return [docs, items, notes]


_PARTS = """p AS (SELECT 0 AS i, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, passage FROM eval_items UNION ALL SELECT 2, ann_id, coalesce(caption, '') FROM annotations),
n AS (SELECT i, id, text, row_number() OVER (PARTITION BY i ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY i) AS c FROM p)"""


@query(f"WITH {_PARTS} SELECT i AS dataset_idx, id, text FROM p")
def mix_concat(spark: SparkSession, d: str) -> DataFrame:
    return mix.concat(_parts(spark, d)).select("dataset_idx", "id", "text")


@query(f"WITH {_PARTS} SELECT k AS turn, i AS dataset_idx, id FROM n WHERE k < (SELECT min(c) FROM n)")
def mix_interleave_under(spark: SparkSession, d: str) -> DataFrame:
    return mix.interleave(_parts(spark, d), "id", "under").select("turn", "dataset_idx", "id")


@query(f"WITH {_PARTS}, t AS (SELECT unnest(range((SELECT max(c) FROM n))) AS turn) SELECT t.turn, n.i AS dataset_idx, n.id FROM t JOIN n ON n.k = t.turn % n.c")
def mix_interleave_over(spark: SparkSession, d: str) -> DataFrame:
    return mix.interleave(_parts(spark, d), "id", "over").select("turn", "dataset_idx", "id")


@query(f"""WITH {_PARTS}, most AS (SELECT CAST(least((SELECT any_value(c) FROM n WHERE i = 0) / 0.5, (SELECT any_value(c) FROM n WHERE i = 1) / 0.2, (SELECT any_value(c) FROM n WHERE i = 2) / 0.3) * 1.2 AS BIGINT) + 100 AS m),
t AS (SELECT turn, CASE WHEN {u_sql(3, 'turn')} < 0.5 THEN 0 WHEN {u_sql(3, 'turn')} < 0.5 + 0.2 THEN 1 ELSE 2 END AS i FROM (SELECT unnest(range((SELECT m FROM most))) AS turn)),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY turn) - 1 AS k FROM t),
s AS (SELECT i, any_value(c) AS c FROM n GROUP BY i), e AS (SELECT min(turn) AS stop FROM k JOIN s USING (i) WHERE k >= c)
SELECT k.turn, k.i AS dataset_idx, n.id FROM k JOIN n ON n.i = k.i AND n.k = k.k WHERE k.turn < (SELECT stop FROM e)""")
def mix_interleave_by_chance(spark: SparkSession, d: str) -> DataFrame:
    return mix.interleave_by_chance(_parts(spark, d), "id", [0.5, 0.2, 0.3], 3).select("turn", "dataset_idx", "id")


@query(f"SELECT rec_id, 0 AS copy FROM vqa_records ORDER BY {u_sql(7, 'rec_id')}, rec_id LIMIT 800")
def sample_exact_n(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the operator: exactly this many rows."""
    return mix.sample_exact(table(spark, d, "vqa_records").select("rec_id"), "rec_id", 800, 7)


@query(f"""WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS c FROM eval_items),
x AS (SELECT CAST(floor({u_sql(8, 'i')} * (SELECT any_value(c) FROM n)) AS BIGINT) AS k, count(*) AS m FROM range(1000 - (SELECT count(*) FROM eval_items)) t(i) GROUP BY 1)
SELECT n.item_id, unnest(range(coalesce(x.m, 0) + 1)) AS copy FROM n LEFT JOIN x USING (k)""")
def sample_with_top_up(spark: SparkSession, d: str) -> DataFrame:
    return mix.sample_exact(table(spark, d, "eval_items").select("item_id"), "item_id", 1000, 7)


@query(f"SELECT rec_id, CASE WHEN {u_sql(42, 'rec_id')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM vqa_records")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return mix.split(table(spark, d, "vqa_records").select("rec_id"), "rec_id", 0.1, 42)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {u_sql(42, 'doc_id')}, doc_id) <= 50 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_count(spark: SparkSession, d: str) -> DataFrame:
    return mix.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 42)


@query(f"""SELECT DISTINCT image_id AS path, CASE WHEN {u_sql(0, 'image_id')} < 0.9 THEN 'train' WHEN {u_sql(0, 'image_id')} < 1.0 THEN 'val' ELSE 'test' END AS split
FROM vqa_records WHERE image_id IN (SELECT image FROM annotations)""")
def autosplit(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "vqa_records").select(F.col("image_id").alias("path")).distinct()
    return mix.autosplit(files, "path", labels=table(spark, d, "annotations").select(F.col("image").alias("path")).distinct())


@query("SELECT rec_id, CAST((row_number() OVER (ORDER BY rec_id) - 1) % 8 AS INTEGER) AS rank FROM vqa_records")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return mix.shard(table(spark, d, "vqa_records").select("rec_id"), "rec_id", 8).select("rec_id", "rank")


@query("""WITH p AS (SELECT DISTINCT image_id FROM vqa_records WHERE image_id IS NOT NULL), n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS k, count(*) OVER () AS c FROM p)
SELECT image_id, CAST(k // greatest(1, CAST(ceil(c / 4) AS BIGINT)) AS INTEGER) AS rank FROM n""")
def shard_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return mix.shard_contiguous(table(spark, d, "vqa_records").where("image_id is not null").select("image_id"), "image_id", 4).select("image_id", "rank")


@query("SELECT doc_id, kind, source FROM documents ORDER BY doc_id LIMIT 20 OFFSET 60")
def page_preview(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the operator: one page."""
    return page(table(spark, d, "documents").select("doc_id", "kind", "source"), "doc_id", 3, 20)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def max_samples_head(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the operator: a head of fixed size."""
    return mix.head(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, k AS row_no FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k >= 10 AND k < 400 AND (k - 10) % 3 = 0")
def index_select(spark: SparkSession, d: str) -> DataFrame:
    """The slice is the operator."""
    return mix.select_rows(table(spark, d, "documents").select("doc_id"), "doc_id", slice(10, 400, 3))


@query("SELECT item_id, unnest(range(3)) AS epoch FROM eval_items")
def repeat_epochs(spark: SparkSession, d: str) -> DataFrame:
    return mix.repeat(table(spark, d, "eval_items").select("item_id"), 3)


@query("SELECT rec_id, 'chosen' AS side, ground_truth AS text FROM vqa_records UNION ALL SELECT rec_id, 'rejected', answer FROM vqa_records")
def stack_pairs(spark: SparkSession, d: str) -> DataFrame:
    return mix.stacked(table(spark, d, "vqa_records"), ["ground_truth"], ["answer"], ["text"], ["rec_id"])


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS cls, CAST(v AS DOUBLE) AS conf FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) WHERE v > 0.25""")
def multi_label_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = mix.multi_label(table(spark, d, "embeddings").withColumn("s", F.col("embedding").cast("array<double>")), "s", 0.25, True)
    return rows.select("vec_id", "cls", "conf")
