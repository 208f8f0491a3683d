"""Anchor grids, the distance codec, and task-aligned assignment of anchors to true boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquarry.functions.geometry import Box, iou_variants


def anchors(spark: SparkSession, levels: list[tuple[int, int, int]], offset: float = 0.5) -> DataFrame:
    """Grid centres of feature maps, ``levels`` of (height, width, stride): anchor_id in order of level, row and column, x, y and stride."""
    out, first = None, 0
    for h, w, stride in levels:
        cell = F.col("id")
        part = spark.range(h * w).select((cell + first).alias("anchor_id"), (cell % w + offset).alias("x"), (F.floor(cell / w) + offset).alias("y"), F.lit(stride).alias("stride"))
        out, first = part if out is None else out.unionByName(part), first + h * w
    if out is None:
        raise ValueError("no levels")
    return out


def distance_to_box(x: Column, y: Column, d: Box, centred: bool = True) -> Box:
    """Left, top, right and bottom distances from an anchor as a box, by centre and size or by corners."""
    x1, y1, x2, y2 = x - d[0], y - d[1], x + d[2], y + d[3]
    return ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1) if centred else (x1, y1, x2, y2)


def box_to_distance(x: Column, y: Column, b: Box, most: float) -> Box:
    """The reverse of ``distance_to_box`` for corners, held between 0 and ``most`` - 0.01."""
    hold = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(most - 0.01))
    return hold(x - b[0]), hold(y - b[1]), hold(b[2] - x), hold(b[3] - y)


def top_anchors(metrics: DataFrame, k: int) -> DataFrame:
    """The ``k`` anchors of greatest metric of each true box, ties by anchor."""
    order = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("metric"), "anchor_id")
    return metrics.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def task_aligned(preds: DataFrame, truths: DataFrame, k: int = 13, alpha: float = 1.0, beta: float = 6.0, eps: float = 1e-9) -> DataFrame:
    """Anchors assigned to true boxes: image_id, anchor_id, gt_id and target, the normalised score.

    ``preds`` holds image_id, anchor_id, its point (ax, ay), the predicted
    corners and ``scores``, an array by class; ``truths`` image_id, gt_id,
    cls and corners. An anchor whose point lies inside a true box has the
    metric score^alpha * overlap^beta there, where the overlap is the
    complete IoU, 0 at least. The ``k`` best anchors of each true box are
    taken; an anchor taken by several goes to the one of highest overlap,
    ties to the first. A target is the metric times the true box's best
    overlap over its best metric.
    """
    t = truths.select("image_id", "gt_id", "cls", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    inside = F.least(F.col("ax") - F.col("_x1"), F.col("ay") - F.col("_y1"), F.col("_x2") - F.col("ax"), F.col("_y2") - F.col("ay")) > eps
    truth, pred = tuple(F.col(f"_{c}").cast("double") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    overlap = F.greatest(iou_variants(truth, pred)["ciou"], F.lit(0.0))
    score = F.coalesce(F.try_element_at("scores", F.col("cls") + 1), F.lit(0.0))
    pairs = preds.join(t, "image_id").where(inside).withColumn("overlap", overlap).withColumn("metric", F.pow(score, F.lit(alpha)) * F.pow("overlap", F.lit(beta)))
    met = pairs.select("image_id", "anchor_id", "gt_id", "overlap", "metric")
    taken = top_anchors(met, k)
    # An anchor of several true boxes goes to the highest overlap of all boxes it lies in.
    several = taken.groupBy("image_id", "anchor_id").agg(F.count(F.lit(1)).alias("_n"), F.first("gt_id").alias("_only"))
    highest = met.groupBy("image_id", "anchor_id").agg(F.max(F.struct("overlap", (-F.col("gt_id")).alias("_g"))).alias("_h"))
    chosen = several.join(highest, ["image_id", "anchor_id"]).select("image_id", "anchor_id", F.when(F.col("_n") == 1, F.col("_only")).otherwise(-F.col("_h._g")).alias("gt_id"))
    final = chosen.join(met, ["image_id", "anchor_id", "gt_id"])
    whole = Window.partitionBy("image_id", "gt_id")
    return final.select("image_id", "anchor_id", "gt_id", (F.col("metric") * F.max("overlap").over(whole) / (F.max("metric").over(whole) + eps)).alias("target"))
