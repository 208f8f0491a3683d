"""Label verification, data set statistics, conversion, batching by shape, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.sources.files import IMAGES
from geoquarry.storage import materialize

#: Class numbers from 91 to 80 classes leave out these numbers of the 91 (from 1).
ABSENT = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)


def label_defect(cls: Column, cx: Column, cy: Column, w: Column, h: Column, classes: int, width: Column | None = None, height: Column | None = None, extension: Column | None = None) -> Column:
    """Why a label is corrupt, or null."""
    out = F.lit(None).cast("string")
    out = F.when((cls < 0) | (cls >= classes), "class out of range").otherwise(out)
    coords = F.array(cx, cy, w, h)
    out = F.when(F.exists(coords, lambda c: c > 1), "coordinates out of bounds").otherwise(out)
    out = F.when(F.exists(coords, lambda c: c < 0), "negative values").otherwise(out)
    out = F.when(F.exists(coords, lambda c: c.isNull()), "missing columns").otherwise(out)
    if width is not None and height is not None:
        out = F.when((width < 10) | (height < 10), "image too small").otherwise(out)
    return out if extension is None else F.when(~F.lower(extension).isin(*IMAGES), "invalid format").otherwise(out)


def verify(labels: DataFrame, classes: int, columns: tuple[str, ...] = ("cls", "cx", "cy", "w", "h")) -> tuple[DataFrame, DataFrame]:
    """Good labels without duplicates in an image, and counts by reason (``ok`` for the good, before duplicates go)."""
    marked = labels.withColumn("reason", label_defect(*[F.col(c) for c in columns], classes=classes))
    good = marked.where("reason is null").drop("reason").dropDuplicates(["image_id", *columns])
    return good, marked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def image_counters(images: DataFrame, labels: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Images missing a label, found, empty and corrupt, as one row. ``labels`` has image_id and n (labels in the file)."""
    state = images.select("image_id").join(labels.select("image_id", "n"), "image_id", "left").join(corrupt.select("image_id", F.lit(True).alias("_bad")).distinct(), "image_id", "left")
    return state.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n").isNotNull()).alias("found"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if("_bad").alias("corrupt"))


def statistics(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Instances and images of each class, and, in the row of a null class, of all; with images that have no label."""
    by = labels.groupBy("cls").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("image_id").alias("images"), F.lit(0).cast("long").alias("unlabelled"))
    bare = images.select("image_id").distinct().join(labels.select("image_id").distinct(), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    whole = labels.agg(F.lit(None).cast("int").alias("cls"), F.count(F.lit(1)).alias("instances"), F.count_distinct("image_id").alias("images"))
    total = whole.unionByName(bare.select(F.lit(-1).alias("cls"), F.lit(0).cast("long").alias("instances"), F.lit(0).cast("long").alias("images"), "unlabelled"), allowMissingColumns=True)
    merged = total.agg(F.lit(None).cast("int").alias("cls"), F.max("instances").alias("instances"), F.max("images").alias("images"), F.max("unlabelled").alias("unlabelled"))
    return by.unionByName(merged)


def to_80(cls91: Column) -> Column:
    """Class number 0..79 of one of 1..91; null for those that are absent."""
    below = sum((F.when(cls91 > a, 1).otherwise(0) for a in ABSENT[1:]), F.when(cls91 > ABSENT[0], 1).otherwise(0))
    return F.when(~cls91.isin(*ABSENT), cls91 - 1 - below)


def coco_labels(images: DataFrame, annotations: DataFrame, remap: bool = True) -> DataFrame:
    """Normalised centre boxes of annotations: no crowds, no empty boxes, equal boxes of an image once.

    images (image_id, width, height), annotations (image_id, category_id, x, y, w, h, iscrowd).
    """
    kept = annotations.where(~F.coalesce(F.col("iscrowd"), F.lit(False)) & (F.col("w") > 0) & (F.col("h") > 0))
    joined = kept.join(images, "image_id")
    cls = to_80(F.col("category_id")) if remap else F.col("category_id") - 1
    box = ((F.col("x") + F.col("w") / 2) / F.col("width"), (F.col("y") + F.col("h") / 2) / F.col("height"), F.col("w") / F.col("width"), F.col("h") / F.col("height"))
    return joined.select("image_id", cls.cast("int").alias("cls"), *[c.alias(n) for c, n in zip(box, ("cx", "cy", "w", "h"))]).dropDuplicates(["image_id", "cls", "cx", "cy", "w", "h"])


def rectangular_batches(images: DataFrame, size: int, side: int, stride: int = 32, pad: float = 0.5) -> DataFrame:
    """Images (image_id, width, height) in batches of like aspect ratio, with the batch's shape rounded up to the stride."""
    from geoquarry.operators.mix import numbered

    ratio = images.withColumn("ratio", F.col("height") / F.col("width")).withColumn("_key", F.struct("ratio", "image_id"))
    placed = numbered(ratio, "_key").withColumn("batch", F.floor(F.col("row_no") / size)).drop("_key", "row_no")
    ends = placed.groupBy("batch").agg(F.min("ratio").alias("_lo"), F.max("ratio").alias("_hi"))
    h = F.when(F.col("_hi") < 1, F.col("_hi")).otherwise(F.lit(1.0))
    w = F.when(F.col("_lo") > 1, 1 / F.col("_lo")).otherwise(F.lit(1.0))
    up = lambda v: (F.ceil(v * side / stride + pad) * stride).cast("int")
    return placed.join(ends.select("batch", up(h).alias("batch_h"), up(w).alias("batch_w")), "batch")


def fingerprint(paths: DataFrame, path: str, size: str) -> DataFrame:
    """sha256 over the total size, as text, and then all paths in order: one row with ``fingerprint``.

    The digest is sequential by definition, so the sorted paths stream
    through one task; nothing but its state is held.
    """
    total = paths.agg(F.coalesce(F.sum(size), F.lit(0)).cast("string").alias("t")).first()["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256(total.encode())
        for batch in batches:
            for p in batch.column(0).to_pylist():
                state.update((p or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["fingerprint"])

    return paths.select(path).orderBy(path).coalesce(1).mapInArrow(run, "fingerprint string")


def cache_valid(manifest: DataFrame, version: str, print_: DataFrame) -> DataFrame:
    """Whether a manifest row (version, hash) still fits: one row with ``valid``."""
    return manifest.select("version", "hash").join(print_.select(F.col("fingerprint").alias("hash"), F.lit(True).alias("_same")), "hash", "left").select(((F.col("version") == version) & F.coalesce("_same", F.lit(False))).alias("valid"))


def without_mismatched_segments(rows: DataFrame, boxes: str, segments: str) -> DataFrame:
    """Segments go where their number differs from the boxes'."""
    return rows.withColumn(segments, F.when(F.size(boxes) == F.size(segments), F.col(segments)))


def check_dataset(config: dict) -> dict:
    """Required keys of a data set description, and names and counts that agree."""
    for key in ("train", "val"):
        if key not in config:
            raise ValueError(f"{key} is missing")
    if "names" not in config and "nc" not in config:
        raise ValueError("names or nc are required")
    if "names" in config and "nc" in config and len(config["names"]) != config["nc"]:
        raise ValueError("names and nc differ")
    names = config.get("names") or [f"class_{i}" for i in range(config["nc"])]
    names = dict(enumerate(names)) if not isinstance(names, dict) else {int(k): v for k, v in names.items()}
    return {**config, "names": names, "nc": len(names)}


def ram_estimate(images: DataFrame, side: int, seed: int = 0, n: int = 30, margin: float = 0.1) -> DataFrame:
    """Bytes of all images at a longest side, extrapolated from ``n`` of them."""
    from geoquarry.operators.mix import draw

    picked = images.orderBy(draw(seed, "image_id"), "image_id").limit(n)
    pixels = F.col("width") * F.col("height") * F.pow(side / F.greatest("width", "height"), 2) * 3
    total = images.count()
    return picked.agg((F.avg(pixels) * total * (1 + margin)).alias("bytes"))


def progress(log: DataFrame, run: str, order: str) -> DataFrame:
    """Share done, mean step time and time left after each log row (run, ts in seconds, step, total)."""
    w = Window.partitionBy(run).orderBy(order)
    elapsed = F.col("ts") - F.first("ts").over(w)
    per = elapsed / F.nullif(F.col("step"), F.lit(0))
    return log.select(run, order, "step", F.round(F.col("step") / F.col("total") * 100, 2).alias("percentage"), elapsed.alias("elapsed"), F.round(per * (F.col("total") - F.col("step")), 6).alias("remaining"))


def run_lengths(pixels: DataFrame, mask: Column) -> DataFrame:
    """Column-wise run lengths of each image's mask, beginning with the zeros: image_id, counts and area."""
    order = Window.partitionBy("image_id").orderBy("x", "y")
    flat = pixels.select("image_id", "x", "y", mask.cast("int").alias("m")).withColumn("_new", F.coalesce((F.col("m") != F.lag("m").over(order)).cast("int"), F.lit(1)))
    runs = flat.withColumn("_run", F.sum("_new").over(order)).groupBy("image_id", "_run").agg(F.max("m").alias("m"), F.count(F.lit(1)).cast("int").alias("n"))
    ordered = runs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("_run", "m", "n"))).alias("r"))
    counts = F.transform("r", lambda x: x["n"])
    lead = F.when(F.col("r")[0]["m"] == 1, F.concat(F.array(F.lit(0)), counts)).otherwise(counts)
    area = F.aggregate("r", F.lit(0), lambda s, x: s + x["m"] * x["n"])
    return ordered.select("image_id", lead.alias("counts"), area.alias("area"))


def retrieve(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 50_000) -> DataFrame:
    """For each query vector (query_id, q) its ``k`` nearest by cosine: rank, cosine and probability.

    The probability is the softmax over 100 times the cosine of all vectors.
    The queries go to the workers in blocks of ``block``, each a pass over
    the vectors; inside an Arrow batch they are taken in parts of 256, and
    each batch gives its best ``k`` for a query and the sum of its weights,
    so that few rows are ranked at the end.
    """
    from geoquarry.operators.mix import numbered

    placed = materialize(numbered(queries.select("query_id", "q"), "query_id", "_n"), "queries")
    count = placed.count()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def one(low: int) -> DataFrame:
        rows = placed.where((F.col("_n") >= low) & (F.col("_n") < low + block)).collect()
        matrix = unit(np.array([r["q"] for r in rows], float).reshape(len(rows), -1))
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qs, m = shared.value
            for batch in batches:
                keys = batch[key].to_numpy()
                v = unit(np.stack(batch[vector].to_numpy()).astype(float))
                for at in range(0, len(qs), 256):
                    cos = m[at : at + 256] @ v.T
                    few = np.lexsort((np.broadcast_to(keys, cos.shape), -np.round(cos, 9)), axis=1)[:, :k]
                    # The batch's weight stands in the first of its rows for a query.
                    weight = np.zeros(few.shape)
                    weight[:, 0] = np.exp(100 * cos).sum(1)
                    yield pd.DataFrame({"query_id": np.repeat(qs[at : at + 256], few.shape[1]), key: keys[few].ravel(), "cosine": np.take_along_axis(cos, few, 1).ravel(), "_z": weight.ravel()})

        return vectors.select(key, vector).mapInPandas(run, f"query_id bigint, {key} bigint, cosine double, _z double")

    parts = reduce(DataFrame.unionByName, [one(low) for low in range(0, max(count, 1), block)])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key)
    ranked = parts.withColumn("rank", F.row_number().over(order)).withColumn("probability", F.exp(100 * F.col("cosine")) / F.sum("_z").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).drop("_z")
