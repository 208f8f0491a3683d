"""Queries: label verification, statistics, conversion, caches, media, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import geometry as G
from geoquarry.operators import quality as Q
from geoquarry.plans.queries import query
from geoquarry.plans.views import BOXES, boxes, truths
from geoquarry.sources import files
from geoquarry.tables import table


def _labels(spark: SparkSession, d: str) -> DataFrame:
    n = G.xyxy_to_xywhn(G.box(), 80, 64)
    return boxes(spark, d).select("image_id", F.when(F.col("cls") == 2, 9).otherwise(F.col("cls")).alias("cls"), *[c.alias(k) for c, k in zip(n, ("cx", "cy", "w", "h"))])


_LABELS = """lb AS (SELECT image_id, CASE WHEN cls = 2 THEN 9 ELSE cls END AS cls, (x1 + x2) / 2 / 80 AS cx, (y1 + y2) / 2 / 64 AS cy, (x2 - x1) / 80 AS w, (y2 - y1) / 64 AS h FROM boxes),
mk AS (SELECT *, CASE WHEN cx < 0 OR cy < 0 OR w < 0 OR h < 0 THEN 'negative values' WHEN cx > 1 OR cy > 1 OR w > 1 OR h > 1 THEN 'coordinates out of bounds' WHEN cls < 0 OR cls >= 5 THEN 'class out of range' END AS reason FROM lb)"""


@query(f"WITH {BOXES}, {_LABELS} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM mk GROUP BY ALL")
def label_verify(spark: SparkSession, d: str) -> DataFrame:
    return Q.verify(_labels(spark, d), 5)[1]


@query(f"WITH {BOXES}, {_LABELS} SELECT DISTINCT image_id, cls, cx, cy, w, h FROM mk WHERE reason IS NULL")
def labels_good(spark: SparkSession, d: str) -> DataFrame:
    return Q.verify(_labels(spark, d), 5)[0]


@query(f"""WITH {BOXES}, i AS (SELECT DISTINCT image_id FROM boxes)
SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images, 0 AS unlabelled FROM gt GROUP BY cls
UNION ALL SELECT NULL, (SELECT count(*) FROM gt), (SELECT count(DISTINCT image_id) FROM gt), (SELECT count(*) FROM i ANTI JOIN gt USING (image_id))""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.statistics(truths(spark, d), boxes(spark, d).select("image_id").distinct())


@query(f"""WITH {BOXES}, c AS (SELECT * FROM (SELECT unnest(range(3)) AS cls))
SELECT c.cls, count(g.gt_id) AS n FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS cls) c LEFT JOIN gt g USING (cls) GROUP BY c.cls""")
def class_targets(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.operators.metrics import per_class_targets

    return per_class_targets(truths(spark, d), spark.range(5).select(F.col("id").cast("int").alias("cls")))


_ABSENT = "(12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)"


@query(f"""WITH {BOXES}, a AS (SELECT image_id, CAST(box_id % 91 + 1 AS INTEGER) AS k, x1 AS x, y1 AS y, x2 - x1 - 15 AS w, y2 - y1 AS h, side = 'gt' AND cls = 0 AS crowd FROM boxes)
SELECT DISTINCT image_id, CASE WHEN k NOT IN {_ABSENT} THEN k - 1 - len(list_filter([12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91], lambda z: z < k)) END::INTEGER AS cls,
 (x + w / 2) / 80 AS cx, (y + h / 2) / 64 AS cy, w / 80 AS w, h / 64 AS h FROM a WHERE NOT crowd AND w > 0 AND h > 0""")
def coco_to_yolo(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    notes = b.select("image_id", (F.col("box_id") % 91 + 1).cast("int").alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1") - 15).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), ((F.col("side") == "gt") & (F.col("cls") == 0)).alias("iscrowd"))
    images = b.select("image_id").distinct().select("image_id", F.lit(80.0).alias("width"), F.lit(64.0).alias("height"))
    return Q.coco_labels(images, notes)


@query("""SELECT DISTINCT image_id FROM vqa_records WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image FROM annotations WHERE image IS NOT NULL)""")
def cache_anti_join(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "vqa_records").where("image_id is not null").select(F.col("image_id").alias("cache_key")).distinct()
    cache = table(spark, d, "annotations").select(F.col("image").alias("cache_key"))
    return files.uncached(images, cache).select(F.col("cache_key").alias("image_id"))


@query("""WITH l AS (SELECT DISTINCT '/media/' || image AS path FROM annotations) SELECT rec_id, CASE WHEN l.path IS NOT NULL THEN l.path ELSE image_id END AS image FROM vqa_records LEFT JOIN l ON l.path = '/media/' || image_id""")
def media_resolve(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "annotations").select(F.concat(F.lit("/media/"), "image").alias("path"))
    rows = table(spark, d, "vqa_records").select("rec_id", F.array("image_id").alias("images"))
    return files.resolve_media(rows, "rec_id", "images", listing, "/media").select("rec_id", F.col("images")[0].alias("image"))


@query("""WITH i AS (SELECT o_orderkey AS image_id, 100 + o_custkey % 50 AS width, 100 + o_orderkey % 90 AS height FROM orders), r AS (SELECT *, height / width AS ratio, row_number() OVER (ORDER BY height / width, o.image_id) - 1 AS k FROM i o),
b AS (SELECT *, k // 16 AS batch FROM r), e AS (SELECT batch, min(ratio) AS lo, max(ratio) AS hi FROM b GROUP BY batch)
SELECT image_id, batch, CAST(ceil(CASE WHEN hi < 1 THEN hi ELSE 1.0 END * 640 / 32 + 0.5) * 32 AS INTEGER) AS batch_h, CAST(ceil(CASE WHEN lo > 1 THEN 1 / lo ELSE 1.0 END * 640 / 32 + 0.5) * 32 AS INTEGER) AS batch_w FROM b JOIN e USING (batch)""")
def rect_batches(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 50 + 100).alias("width"), (F.col("o_orderkey") % 90 + 100).alias("height"))
    return Q.rectangular_batches(images, 16, 640).select("image_id", "batch", "batch_h", "batch_w")


@query(r"""SELECT DISTINCT image_id, regexp_replace(regexp_replace(image_id, '^(.*)/images/', '\1/labels/'), '\.[^./]*$', '') || '.txt' AS label FROM vqa_records WHERE image_id IS NOT NULL""")
def label_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").where("image_id is not null").select("image_id").distinct()
    return rows.select("image_id", files.label_path(F.col("image_id")).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN a.w * a.h < 3000 THEN CAST(floor(a.w * sqrt(3000.0 / (a.w * a.h))) AS INTEGER) ELSE a.w END AS w, CASE WHEN a.w * a.h < 3000 THEN CAST(floor(a.h * sqrt(3000.0 / (a.w * a.h))) AS INTEGER) ELSE a.h END AS h FROM (
 SELECT o_orderkey, CASE WHEN w * h > 9000 THEN CAST(floor(w * sqrt(9000.0 / (w * h))) AS INTEGER) ELSE CAST(w AS INTEGER) END AS w, CASE WHEN w * h > 9000 THEN CAST(floor(h * sqrt(9000.0 / (w * h))) AS INTEGER) ELSE CAST(h AS INTEGER) END AS h
 FROM (SELECT o_orderkey, 20 + o_custkey % 150 AS w, 20 + o_orderkey % 130 AS h FROM orders)) a""")
def pixel_budget(spark: SparkSession, d: str) -> DataFrame:
    w, h = G.pixel_budget((F.col("o_custkey") % 150 + 20), (F.col("o_orderkey") % 130 + 20), 9000, 3000)
    return table(spark, d, "orders").select("o_orderkey", w.alias("w"), h.alias("h"))


@query("""WITH f AS (SELECT o_orderkey, greatest(least(floor((o_custkey % 40) / 2.0), 5 + o_orderkey % 60, 12), 1) AS n, 5 + o_orderkey % 60 AS t FROM orders), e AS (SELECT o_orderkey, n, t, unnest(range(CAST(n AS BIGINT))) AS i FROM f)
SELECT o_orderkey, i AS k, CASE WHEN n = 1 THEN 0 ELSE CAST(floor(i * (t - 1) / greatest(n - 1, 1)) AS INTEGER) END AS frame FROM e""")
def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    picks = G.frame_indices((F.col("o_custkey") % 40).cast("double"), (F.col("o_orderkey") % 60 + 5), 0.5, 12)
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(picks).alias("k", "frame")).select("o_orderkey", F.col("k").cast("long").alias("k"), "frame")


@query("""SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Registry-style lookups: two dimension tables, whose broadcast Spark decides by size."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT sha256(sum(length(image_id))::BIGINT || string_agg(image_id, '' ORDER BY encode(image_id))) AS fingerprint FROM (SELECT DISTINCT image_id FROM vqa_records WHERE image_id IS NOT NULL)")
def cache_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").where("image_id is not null").select("image_id").distinct().withColumn("size", F.length("image_id"))
    return Q.fingerprint(rows, "image_id", "size")
