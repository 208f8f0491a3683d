"""Matching of detections to truths, precision and recall, confusion matrices and other scores.

Tables: detections (image_id, det_id, x1, y1, x2, y2, conf, cls) and truths
(image_id, gt_id, x1, y1, x2, y2, cls). All pairs are formed inside one
image; the image is the equi key of every join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.functions.geometry import box, iou

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def iou_pairs(dets: DataFrame, truths: DataFrame, least: float, same_class: bool = True) -> DataFrame:
    """Pairs of a detection and a truth of one image that overlap by ``least`` or more.

    Both sides are narrowed before the join; the predicate runs inside it,
    so that pairs below the threshold never leave their task.
    """
    d = dets.select("image_id", "det_id", "conf", F.col("cls").alias("det_cls"), *[F.col(c).alias(f"d{c}") for c in ("x1", "y1", "x2", "y2")])
    t = truths.select(F.col("image_id").alias("_image"), "gt_id", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    overlap = iou(box("t"), box("d"))
    on = (F.col("image_id") == F.col("_image")) & (overlap >= least)
    if same_class:
        on = on & (F.col("det_cls") == F.col("gt_cls"))
    return d.join(t, on).select("image_id", "det_id", "gt_id", "conf", "det_cls", "gt_cls", overlap.alias("iou"))


def greedy_match(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """1:1 matches for each threshold: the best truth of each detection, then of a truth's detections the one with the lowest id."""
    at = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col("iou") >= F.col("threshold"))
    best = Window.partitionBy("threshold", "image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    one = Window.partitionBy("threshold", "image_id", "gt_id").orderBy("det_id")
    kept = at.withColumn("_d", F.row_number().over(best)).where("_d = 1")
    return kept.withColumn("_g", F.row_number().over(one)).where("_g = 1").drop("_d", "_g")


def confusion_match(dets: DataFrame, truths: DataFrame, conf: float = 0.25, least: float = 0.45) -> DataFrame:
    """1:1 matches regardless of class, by falling overlap: best truth of a detection, then best detection of a truth."""
    pairs = iou_pairs(dets.where(F.col("conf") > conf), truths, least, same_class=False).where(F.col("iou") > least)
    best = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    one = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), "det_id")
    kept = pairs.withColumn("_d", F.row_number().over(best)).where("_d = 1")
    return kept.withColumn("_g", F.row_number().over(one)).where("_g = 1").drop("_d", "_g")


def confusion_matrix(dets: DataFrame, truths: DataFrame, classes: int, conf: float = 0.25, least: float = 0.45, only_matched_images: bool = False) -> DataFrame:
    """Counts by predicted and true class; the class number ``classes`` stands for background.

    A truth without a match counts as predicted background, a detection
    without one as true background; with ``only_matched_images`` the latter
    only in images that have a match.
    """
    matches = confusion_match(dets, truths, conf, least).select("image_id", "det_id", "gt_id")
    good = dets.where(F.col("conf") > conf)
    d = good.select("image_id", "det_id", F.col("cls").alias("pred"))
    t = truths.select("image_id", "gt_id", F.col("cls").alias("true"))
    found = matches.join(t, ["image_id", "gt_id"]).join(d, ["image_id", "det_id"]).select("pred", "true")
    missed = t.join(matches, ["image_id", "gt_id"], "left_anti").select(F.lit(classes).alias("pred"), "true")
    extra = d.join(matches, ["image_id", "det_id"], "left_anti")
    if only_matched_images:
        extra = extra.join(matches.select("image_id").distinct(), "image_id", "left_semi")
    background = extra.select("pred", F.lit(classes).alias("true"))
    return found.unionByName(missed).unionByName(background).groupBy("pred", "true").agg(F.count(F.lit(1)).alias("n"))


def true_false(matrix: DataFrame, classes: int) -> DataFrame:
    """True and false positives of each class of a confusion matrix, without the background row."""
    by = matrix.where(F.col("pred") < classes).groupBy(F.col("pred").alias("cls"))
    return by.agg(F.sum(F.when(F.col("pred") == F.col("true"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("pred") != F.col("true"), F.col("n")).otherwise(0)).alias("fp"))


def classification_matrix(rows: DataFrame, pred: str, true: str) -> DataFrame:
    return rows.groupBy(F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count(F.lit(1)).alias("n"))


def _cumulative(rows: DataFrame, group: list[str], order: list[Column], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Running sums in a group that needn't fit one task: sums of buckets before, plus a window inside the bucket."""
    marked = rows.withColumn("_b", bucket)
    sums = marked.groupBy(*group, "_b").agg(*[F.sum(v).alias(f"_s_{k}") for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_b", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(offsets, [*group, "_b"])
    return joined.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"_o_{k}")).alias(k) for k, v in values.items()])


def precision_recall(dets: DataFrame, truths: DataFrame, matches: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Precision and recall after each detection, for each class and threshold of ``matches``, by falling confidence.

    Confidences are bucketed by thousandths so that a frequent class is not
    one task; ties are in the order of image and detection.
    """
    hits = matches.groupBy("image_id", "det_id").agg(F.collect_set("threshold").alias("_at"))
    marked = dets.select("image_id", "det_id", "conf", "cls").join(hits, ["image_id", "det_id"], "left")
    # One column a threshold, so that detections are joined and sorted once.
    names = [f"_t{i}" for i in range(len(thresholds))]
    wide = marked.select("image_id", "det_id", "conf", "cls", *[F.coalesce(F.array_contains("_at", t), F.lit(False)).cast("int").alias(n) for n, t in zip(names, thresholds)])
    total = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n_true"))
    sums = _cumulative(wide, ["cls"], [F.desc("conf"), F.asc("image_id"), F.asc("det_id")], F.floor(F.col("conf") * 1000), {**{f"tp{n}": F.col(n) for n in names}, "seen": F.lit(1)})
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{n}").alias("tp")) for n, t in zip(names, thresholds)]))
    long = sums.select("cls", "image_id", "det_id", "conf", "seen", each.alias("_e")).select("*", "_e.threshold", "_e.tp")
    joined = long.join(total, "cls")
    return joined.select(
        "threshold", "cls", "image_id", "det_id", "conf", "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / (F.col("n_true") + 1e-16)).alias("recall"), (F.col("tp") / F.col("seen")).alias("precision"), "n_true"
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """AP for each class and threshold: the precision envelope read at 101 recalls, then the trapezoid rule.

    The envelope is the greatest precision at this place of the curve or
    after it, with a first point (0, 1) and a last one (1, 0); it is read by
    straight lines between points. Recall levels are collected in buckets
    between the grid's values, each with its ends and best precision, so that
    no window holds more than about 300 rows of a class.
    """
    hundred = F.col("recall") * 100
    on_grid = F.abs(hundred - F.round(hundred)) < 1e-9
    levels = curve.groupBy("threshold", "cls", "recall").agg(F.max("precision").alias("p_first"), F.min("precision").alias("p_last"))
    place = F.when(on_grid, F.round(hundred) * 2).otherwise(F.floor(hundred) * 2 + 1).cast("int")
    buckets = levels.groupBy("threshold", "cls", place.alias("k")).agg(
        F.min("recall").alias("low"), F.max("recall").alias("high"), F.max("p_first").alias("top"), F.max_by("p_last", "recall").alias("end")
    )
    w = Window.partitionBy("threshold", "cls").orderBy("k")
    later = F.max("top").over(w.rowsBetween(1, Window.unboundedFollowing))
    known = buckets.select("threshold", "cls", "k", "low", "high", F.greatest("top", later).alias("rise"), F.greatest("end", later).alias("fall"), F.lit(None).cast("int").alias("g"))
    grid = curve.select("threshold", "cls").distinct().select("threshold", "cls", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("g"))
    marks = grid.select("threshold", "cls", (F.col("g") * 2).alias("k"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high", "rise", "fall")], "g")
    order = Window.partitionBy("threshold", "cls").orderBy("k", F.col("g").isNotNull())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    a = F.coalesce(F.last("high", True).over(back), F.lit(0.0))
    ea = F.coalesce(F.last("fall", True).over(back), F.lit(1.0))
    b = F.coalesce(F.first("low", True).over(ahead), F.lit(1.0))
    eb = F.coalesce(F.first("rise", True).over(ahead), F.lit(0.0))
    read = known.unionByName(marks).select("threshold", "cls", "g", a.alias("a"), ea.alias("ea"), b.alias("b"), eb.alias("eb")).where("g is not null")
    x = F.col("g") / 100
    line = F.col("ea") + (F.col("eb") - F.col("ea")) * (x - F.col("a")) / F.expr("nullif(b - a, 0)")
    value = F.when(F.col("g") == 100, 0.0).when((F.abs(x - F.col("a")) < 1e-11) | (F.col("b") <= F.col("a")), F.col("ea")).otherwise(line)
    return read.groupBy("threshold", "cls").agg(F.sum(value * F.when(F.col("g").isin(0, 100), 0.005).otherwise(0.01)).alias("ap"))


def mean_metrics(ap: DataFrame) -> DataFrame:
    """map50, map75, map and fitness over classes."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    means = ap.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map"))
    return means.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def class_maps(ap: DataFrame, classes: int) -> DataFrame:
    """cls and map of every class from 0 on, by its own thresholds; classes without detections or truths take the mean of all."""
    own = ap.groupBy("cls").agg(F.avg("ap").alias("_own"))
    mean = ap.groupBy("cls").agg(F.avg("ap").alias("_m")).agg(F.avg("_m").alias("_mean"))
    every = ap.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(own, "cls", "left").join(F.broadcast(mean)).select("cls", F.coalesce("_own", "_mean", F.lit(0.0)).alias("map"))


def mean_results(best: DataFrame, ap: DataFrame) -> DataFrame:
    """mp and mr, the means of the classes' precision and recall at their best F1, beside ``mean_metrics``."""
    means = best.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"))
    return means.join(F.broadcast(mean_metrics(ap)))


def smoothed(curve: DataFrame, group: list[str], order: str, value: str, part: float = 0.05) -> DataFrame:
    """Moving average of odd width (2 * part of the points), edge values repeated beyond the ends. One curve is one small group."""
    w = Window.partitionBy(*group).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    numbered = curve.withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    half = F.floor(F.floor(F.round(F.col("_n") * part * 2)) / 2).cast("int")
    series = numbered.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", value))).alias("_s"))
    joined = numbered.join(series, group)
    window = F.transform(F.sequence(-half, half), lambda k: F.element_at(F.col("_s"), F.least(F.greatest(F.col("_i") + k, F.lit(1)), F.col("_n")).cast("int"))[value])
    return joined.withColumn("smooth", F.aggregate(window, F.lit(0.0), lambda s, x: s + x) / (2 * half + 1)).drop("_i", "_n", "_s")


def best_f1(curve: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each class the precision, recall and F1 where its F1 is greatest at ``threshold``."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + 1e-16)
    rows = curve.where(F.abs(F.col("threshold") - threshold) < 1e-9).select("cls", p, r, f1.alias("f1"), "conf")
    return rows.groupBy("cls").agg(F.max(F.struct("f1", "conf", "precision", "recall")).alias("_b")).select("cls", "_b.precision", "_b.recall", "_b.f1", "_b.conf")


def per_class_targets(truths: DataFrame, classes: DataFrame) -> DataFrame:
    """Truths by class, zero for classes of ``classes`` (cls) without one."""
    n = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return classes.join(n, "cls", "left").fillna(0, ["n"])


def topk_accuracy(rows: DataFrame, ranked: str, target: str) -> DataFrame:
    """Share of rows whose target is the first, or among the first five, of an array of ranked classes."""
    hit = lambda k: F.avg(F.array_contains(F.slice(ranked, 1, k), F.col(target)).cast("double"))
    return rows.agg(hit(1).alias("top1"), hit(5).alias("top5"))


def top_classes(scores: Column, k: int = 5) -> Column:
    """Places of the ``k`` largest values of an array, from 0; ties by place."""
    pairs = F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def choice(scores: Column, letters: str = "ABCD") -> Column:
    """The letter of the largest score."""
    return F.element_at(F.array(*[F.lit(c) for c in letters]), F.array_position(scores, F.array_max(scores)).cast("int"))


def choice_accuracy(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy by category and, in the row ``Average``, over all rows."""
    rolled = rows.withColumn("_c", correct.cast("double")).rollup(category).agg(F.avg("_c").alias("accuracy"), F.count(F.lit(1)).alias("n"), F.grouping(category).alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, "Average").otherwise(F.col(category)).alias("category"), "accuracy", "n")


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of next tokens predicted, over labels that count: prediction i is for label i + 1."""
    pairs = F.zip_with(F.slice(predicted, F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    counted = F.filter(pairs, lambda x: x["t"] != ignore)
    return F.when(F.size(counted) > 0, F.size(F.filter(counted, lambda x: x["p"] == x["t"])) / F.size(counted))


def sequence_logp(logps: Column, labels: Column, ignore: int = -100) -> Column:
    """Sum of log-probabilities of the shifted labels that count."""
    pairs = F.zip_with(F.slice(logps, F.lit(1), F.greatest(F.size(logps) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, t: F.when(t == ignore, 0.0).otherwise(p))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def reward_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return rows.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def throughput(rows: DataFrame, ids: list[str], epochs: float, seconds: float, world: int = 1) -> DataFrame:
    """Tokens a second and worker over a run."""
    total = sum((F.sum(F.size(c)) for c in ids[1:]), F.sum(F.size(ids[0])))
    return rows.agg((total * epochs / seconds / world).alias("tokens_per_second"))


def weighted_average(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"))


def feedback_balance(rows: DataFrame, tag: str, group: str | None = None) -> DataFrame:
    """Desirable and undesirable rows, and whether one side is missing."""
    by = rows.groupBy(group) if group else rows.groupBy()
    return by.agg(F.count_if(F.col(tag)).alias("desirable"), F.count_if(~F.col(tag)).alias("undesirable")).withColumn("one_sided", (F.col("desirable") == 0) | (F.col("undesirable") == 0))


def sigma_clip(rows: DataFrame, group: list[str], value: str, sigma: float = 2.0, rounds: int = 3) -> DataFrame:
    """Drops values beyond ``sigma`` population deviations of their group's mean, in a few rounds."""
    for _ in range(rounds):
        stats = rows.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        rows = rows.join(stats, group).where(F.abs(F.col(value) - F.col("_m")) <= sigma * F.col("_s") + 1e-12).drop("_m", "_s")
    return rows


def ema(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Exponential smoothing of each group's values in order; the weight depends on their number: 1.8 (sigmoid(0.05 n) - 0.5).

    Returns group, the place from 1 and ``smooth``. Rows come sorted and pass
    through once, with nothing kept but the last value, so a group of any
    length takes linear time and no memory. Null values keep the last one.
    """
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(counts, F.col(group).eqNullSafe(F.col("_g"))).select(group, "_n", F.col(value).cast("double").alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    placed = joined.repartition(group).sortWithinPartitions(group, *[f"_o{i}" for i in range(len(order))]).select(group, "_n", "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, k, begun = None, 0.0, 0, False
        for batch in batches:
            ks, out = [], []
            for g, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or g != now:
                    now, last, k, begun = g, v if v is not None else 0.0, 0, True
                w = 1.8 * (1 / (1 + math.exp(-0.05 * n)) - 0.5)
                last = last if v is None else last * w + (1 - w) * v
                k += 1
                ks.append(k), out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ks, pa.int64()), pa.array(out, pa.float64())], [group, "k", "smooth"])

    return placed.mapInArrow(run, f"`{group}` {rows.schema[group].dataType.simpleString()}, k bigint, smooth double")


def preference_losses(chosen: Column, rejected: Column, beta: float = 0.1, gamma: float = 0.5) -> dict[str, Column]:
    """ORPO's odds-ratio term and SimPO's loss of mean log-probabilities."""
    soft = lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))  # noqa: E731  -log sigmoid(x)
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return {"orpo": soft(odds) * beta - chosen, "simpo": soft((chosen - rejected - gamma / beta) * beta)}


def confident_loss(nll: Column) -> Column:
    """A token's loss weighted by its probability."""
    return F.exp(-nll) * nll
