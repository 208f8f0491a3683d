"""Queries: choosing masks by prompt, patches, anchors and task-aligned assignment, vision windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions.geometry import box
from geoquarry.operators import anchors, collate, prompts
from geoquarry.plans.queries import query
from geoquarry.plans.views import BOXES, RASTER, detections, raster, truths
from geoquarry.tables import table


def masks(spark: SparkSession, d: str) -> DataFrame:
    """The regions of the small images as masks, and a further mask, 100, over all pixels above 0."""
    pixels = raster(spark, d)
    return pixels.where("label >= 0").select("image_id", F.col("label").alias("mask_id"), "y", "x").unionByName(pixels.where("v > 0").select("image_id", F.lit(100).alias("mask_id"), "y", "x"))


MASKS = f"{RASTER}, masks AS (SELECT image_id, label AS mask_id, y, x FROM raster WHERE label >= 0 UNION ALL SELECT image_id, 100, y, x FROM raster WHERE v > 0)"


@query(f"WITH {MASKS} SELECT image_id, mask_id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM masks GROUP BY ALL HAVING count(*) >= 5")
def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    return prompts.mask_boxes(masks(spark, d), 5)


_PROMPTS = "prompts AS (SELECT DISTINCT image_id, k AS prompt_id, image_id % 4 + 0.4 AS x1, k - 0.6 AS y1, image_id % 4 + 3.7 AS x2, k * 3 + 9.2 AS y2 FROM raster, (SELECT unnest([0, 1]) AS k))"


@query(f"""WITH {MASKS}, {_PROMPTS},
b AS (SELECT image_id, prompt_id, least(greatest(round_even(x1, 0), 0), 8) AS x1, least(greatest(round_even(y1, 0), 0), 8) AS y1, least(greatest(round_even(x2, 0), 0), 8) AS x2, least(greatest(round_even(y2, 0), 0), 8) AS y2 FROM prompts),
s AS (SELECT image_id, mask_id, count(*) AS area FROM masks GROUP BY ALL),
m AS (SELECT b.image_id, b.prompt_id, m.mask_id, count(*) AS n FROM b JOIN masks m ON m.image_id = b.image_id AND m.x >= b.x1 AND m.x < b.x2 AND m.y >= b.y1 AND m.y < b.y2 GROUP BY ALL),
i AS (SELECT b.image_id, b.prompt_id, s.mask_id, coalesce(m.n, 0) / ((b.x2 - b.x1) * (b.y2 - b.y1) + s.area - coalesce(m.n, 0)) AS iou FROM b JOIN s USING (image_id) LEFT JOIN m ON m.image_id = b.image_id AND m.prompt_id = b.prompt_id AND m.mask_id = s.mask_id)
SELECT image_id, prompt_id, mask_id, CAST(iou AS DOUBLE) AS iou FROM i QUALIFY row_number() OVER (PARTITION BY image_id, prompt_id ORDER BY iou DESC, mask_id) = 1""")
def box_prompt(spark: SparkSession, d: str) -> DataFrame:
    images = raster(spark, d).select("image_id").distinct()
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("prompt_id")
    at = (F.col("image_id") % 4).cast("double")
    asked = images.select("image_id", k).select("image_id", "prompt_id", (at + 0.4).alias("x1"), (F.col("prompt_id") - 0.6).alias("y1"), (at + 3.7).alias("x2"), (F.col("prompt_id") * 3 + 9.2).alias("y2"))
    return prompts.by_box(masks(spark, d), asked, 8, 8)


@query(f"""WITH {MASKS}, points AS (SELECT image_id, k AS point_id, CAST((image_id + k * 3) % 8 AS INTEGER) AS y, CAST((image_id + k) % 8 AS INTEGER) AS x, CASE WHEN (image_id + k) % 3 = 0 THEN 0 ELSE 1 END AS wanted FROM (SELECT DISTINCT image_id FROM raster), (SELECT unnest([0, 1, 2]) AS k)),
s AS (SELECT image_id, mask_id, count(*) AS area FROM masks GROUP BY ALL),
h AS (SELECT m.image_id, m.mask_id, arg_max(p.wanted, p.point_id) AS w FROM masks m JOIN points p USING (image_id, y, x) GROUP BY ALL),
f AS (SELECT m.image_id, m.y, m.x, h.w FROM masks m JOIN h USING (image_id, mask_id) JOIN s USING (image_id, mask_id) QUALIFY row_number() OVER (PARTITION BY m.image_id, m.y, m.x ORDER BY s.area, m.mask_id DESC) = 1)
SELECT image_id, y, x FROM f WHERE w = 1""")
def point_prompt(spark: SparkSession, d: str) -> DataFrame:
    images = raster(spark, d).select("image_id").distinct()
    k, i = F.col("point_id"), F.col("image_id")
    asked = images.select("image_id", F.explode(F.array(*map(F.lit, range(3)))).alias("point_id")).select("image_id", "point_id", ((i + k * 3) % 8).cast("int").alias("y"), ((i + k) % 8).cast("int").alias("x"), F.when((i + k) % 3 == 0, 0).otherwise(1).alias("wanted"))
    return prompts.by_points(masks(spark, d), asked)


@query(f"""WITH {MASKS}, s AS (SELECT image_id, mask_id, count(*) AS area FROM masks GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mask_id) - 1 AS place FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY place) - 1 AS rank, (mask_id * 7 + image_id) % 11 AS score FROM p WHERE area > 6),
b AS (SELECT image_id, rank FROM l QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, rank DESC) = 1)
SELECT b.image_id, b.rank + (SELECT count(*) FROM p WHERE p.image_id = b.image_id AND p.area <= 6 AND p.place <= b.rank) AS chosen FROM b""")
def text_prompt(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    sizes = prompts.mask_boxes(masks(spark, d)).withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("mask_id")) - 1)
    scores = sizes.select("image_id", "place", ((F.col("mask_id") * 7 + F.col("image_id")) % 11).alias("score"))
    return prompts.by_text(sizes.select("image_id", "place", "area"), scores, 6)


@query(f"WITH {BOXES}, b AS (SELECT image_id, det_id, cls FROM det) SELECT image_id, count(*) > 0 AS some FROM b GROUP BY image_id")
def crop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Images that keep a box after suppression between crops: all that have one, since the surest is never dropped."""
    rows = detections(spark, d).withColumn("crop_area", F.when(F.col("cls") == 0, 10000.0).otherwise(2500.0))
    return prompts.between_crops(rows).groupBy("image_id").agg((F.count(F.lit(1)) > 0).alias("some"))


@query()
def region_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return prompts.cleaned(masks(spark, d), 8, 8, 3)


@query(f"""WITH {RASTER}, b AS (SELECT image_id, label AS region, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, sum(v) AS total FROM raster WHERE label >= 0 GROUP BY ALL)
SELECT image_id, region, CAST(greatest(h, w) * greatest(h, w) AS BIGINT) AS cells, round(total, 6) AS total FROM b""")
def patch_sums(spark: SparkSession, d: str) -> DataFrame:
    """Patches at their own size: the sum of a patch is that of its region."""
    from pyspark.sql import Window

    pixels = raster(spark, d).where("label >= 0")
    whole = Window.partitionBy("image_id", "label")
    side = F.greatest(F.max("y").over(whole) - F.min("y").over(whole), F.max("x").over(whole) - F.min("x").over(whole)) + 1
    sized = pixels.withColumn("side", side)
    parts = [prompts.patches(sized.where(F.col("side") == n), ["v"], n) for n in range(1, 9)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("image_id", "region", F.size("values").cast("bigint").alias("cells"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


_LEVELS = [(8, 10, 8), (4, 5, 16), (2, 3, 32)]


@query(" UNION ALL ".join(f"SELECT CAST({sum(h * w for h, w, _ in _LEVELS[:i])} + k AS BIGINT) AS anchor_id, CAST(k % {w} + 0.5 AS DOUBLE) AS x, CAST(k // {w} + 0.5 AS DOUBLE) AS y, {s} AS stride FROM (SELECT unnest(range({h * w})) AS k)" for i, (h, w, s) in enumerate(_LEVELS)))
def anchor_grid(spark: SparkSession, d: str) -> DataFrame:
    return anchors.anchors(spark, _LEVELS).select("anchor_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "stride")


@query(f"""WITH {BOXES}, l AS (SELECT *, least(greatest(30.5 - x1, 0.0), 15.99) AS l, least(greatest(25.5 - y1, 0.0), 15.99) AS t, least(greatest(x2 - 30.5, 0.0), 15.99) AS r, least(greatest(y2 - 25.5, 0.0), 15.99) AS b FROM boxes)
SELECT image_id, box_id, l, t, r, b, ((30.5 - l) + (30.5 + r)) / 2 AS cx, ((25.5 - t) + (25.5 + b)) / 2 AS cy, l + r AS w, t + b AS h FROM l""")
def distance_codec(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.plans.views import boxes

    x, y = F.lit(30.5), F.lit(25.5)
    dist = anchors.box_to_distance(x, y, box(), 16)
    rows = boxes(spark, d).select("image_id", "box_id", *[c.alias(n) for n, c in zip("ltrb", dist)])
    back = anchors.distance_to_box(x, y, tuple(F.col(c) for c in "ltrb"))
    return rows.select("image_id", "box_id", "l", "t", "r", "b", *[F.round(c, 9).alias(n) for n, c in zip(("cx", "cy", "w", "h"), back)])


_CIOU = """(base - (apart / diagonal + v * (v / (v - base + (1 + 1e-7)))))"""


@query(f"""WITH {BOXES}, g AS (
  SELECT d.image_id, d.det_id AS anchor_id, g.gt_id, CASE WHEN d.cls = g.cls THEN d.conf ELSE d.conf / 4 END AS score, g.x2 - g.x1 AS w1, g.y2 - g.y1 + 1e-7 AS h1, d.x2 - d.x1 AS w2, d.y2 - d.y1 + 1e-7 AS h2,
    greatest(least(g.x2, d.x2) - greatest(g.x1, d.x1), 0.0) * greatest(least(g.y2, d.y2) - greatest(g.y1, d.y1), 0.0) AS inter,
    greatest(g.x2, d.x2) - least(g.x1, d.x1) AS cw, greatest(g.y2, d.y2) - least(g.y1, d.y1) AS ch, d.x1 + d.x2 - g.x1 - g.x2 AS dx, d.y1 + d.y2 - g.y1 - g.y2 AS dy
  FROM det d JOIN gt g ON d.image_id = g.image_id AND least((d.x1 + d.x2) / 2 - g.x1, (d.y1 + d.y2) / 2 - g.y1, g.x2 - (d.x1 + d.x2) / 2, g.y2 - (d.y1 + d.y2) / 2) > 1e-9),
u AS (SELECT *, inter / (w1 * h1 + w2 * h2 - inter + 1e-7) AS base, (dx * dx + dy * dy) / 4 AS apart, cw * cw + ch * ch + 1e-7 AS diagonal, power(atan(w2 / h2) - atan(w1 / h1), 2) * (4 / pi() ** 2) AS v FROM g),
o AS (SELECT image_id, anchor_id, gt_id, greatest({_CIOU}, 0.0) AS overlap, score * power(greatest({_CIOU}, 0.0), 6.0) AS metric FROM u),
t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY metric DESC, anchor_id) <= 3),
n AS (SELECT image_id, anchor_id, count(*) AS n, any_value(gt_id) AS only FROM t GROUP BY ALL),
h AS (SELECT image_id, anchor_id, gt_id FROM o QUALIFY row_number() OVER (PARTITION BY image_id, anchor_id ORDER BY overlap DESC, gt_id) = 1),
c AS (SELECT n.image_id, n.anchor_id, CASE WHEN n.n = 1 THEN n.only ELSE h.gt_id END AS gt_id FROM n JOIN h USING (image_id, anchor_id))
SELECT c.image_id, c.anchor_id, c.gt_id, round(o.metric * max(o.overlap) OVER w / (max(o.metric) OVER w + 1e-9), 6) AS target FROM c JOIN o USING (image_id, anchor_id, gt_id) WINDOW w AS (PARTITION BY c.image_id, c.gt_id)""")
def task_aligned(spark: SparkSession, d: str) -> DataFrame:
    score = F.array(*[F.when(F.col("cls") == i, F.col("conf")).otherwise(F.col("conf") / 4) for i in range(3)])
    preds = detections(spark, d).select("image_id", F.col("det_id").alias("anchor_id"), ((F.col("x1") + F.col("x2")) / 2).alias("ax"), ((F.col("y1") + F.col("y2")) / 2).alias("ay"), "x1", "y1", "x2", "y2", score.alias("scores"))
    return anchors.task_aligned(preds, truths(spark, d), k=3).withColumn("target", F.round("target", 6))


_GRIDS = "g AS (SELECT ann_id, 1 AS g, 1 AS t, CAST(ann_id % 5 + 2 AS INTEGER) * 2 AS h, CAST(ann_id % 7 + 1 AS INTEGER) * 2 AS w FROM annotations UNION ALL SELECT ann_id, 2, 2, 4, CAST(ann_id % 3 + 3 AS INTEGER) * 2 FROM annotations WHERE ann_id % 2 = 0)"


@query(f"""WITH {_GRIDS}, n AS (SELECT *, h // 2 AS hh, w // 2 AS ww, coalesce(sum(t * (h // 2) * (w // 2)) OVER (PARTITION BY ann_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM g),
c AS (SELECT *, unnest(range(t * hh * ww)) AS c FROM n)
SELECT ann_id, row_number() OVER (PARTITION BY ann_id ORDER BY g, c // (hh * ww), ((c // ww) % hh) // 4, (c % ww) // 4, (c // ww) % hh, c % ww) - 1 AS place, CAST(first + c AS BIGINT) AS cell FROM c""")
def vision_windows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("ann_id")
    notes = table(spark, d, "annotations")
    first = notes.select("ann_id", F.lit(1).alias("g"), F.lit(1).alias("t"), ((i % 5 + 2).cast("int") * 2).alias("h"), ((i % 7 + 1).cast("int") * 2).alias("w"))
    second = notes.where(i % 2 == 0).select("ann_id", F.lit(2).alias("g"), F.lit(2).alias("t"), F.lit(4).alias("h"), ((i % 3 + 3).cast("int") * 2).alias("w"))
    return collate.vision_windows(first.unionByName(second), "ann_id", 4)


@query(f"""WITH {_GRIDS}, w AS (SELECT *, list_transform(range((h // 2) // 4 + 1), lambda k: least(4, h // 2 - k * 4)) AS a, list_transform(range((w // 2) // 4 + 1), lambda k: least(4, w // 2 - k * 4)) AS b FROM g WHERE g = 1),
l AS (SELECT ann_id, flatten(list_transform(a, lambda x: list_transform(b, lambda y: x * y * 4))) AS l FROM w)
SELECT ann_id, list_concat([0], list_transform(range(1, len(l) + 1), lambda k: list_sum(l[1:k]))) AS cu FROM l""")
def window_lengths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("ann_id")
    return table(spark, d, "annotations").select("ann_id", collate.window_lengths(F.lit(1), (i % 5 + 2).cast("int") * 2, (i % 7 + 1).cast("int") * 2, 4).alias("cu"))
