"""Batches at the model's boundary: padding, media runs, feedback batches; and vision windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def padded(values: Column, length: Column, pad: int, left: bool = False) -> Column:
    """An array at a length: what is missing is padded at the end, or at the beginning."""
    gap = F.array_repeat(F.lit(pad), F.greatest(length - F.size(values), F.lit(0)).cast("int"))
    return F.concat(gap, values) if left else F.concat(values, gap)


def media_run(ids: Column, token: int, wanted: Column) -> Column:
    """Ids whose run of media tokens is rebuilt to the wanted number, at the place of the first one; without any they stay.

    A run that was cut or that counts another size of image is mended so.
    """
    at = F.array_position(ids, token).cast("int")
    rest = lambda x: F.filter(x, lambda i: i != token)
    before, after = F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(ids, F.greatest(at, F.lit(1)), F.size(ids))
    return F.when(at > 0, F.concat(before, F.array_repeat(F.lit(token), wanted.cast("int")), rest(after))).otherwise(ids)


def multimodal_batch(rows: DataFrame, batch: str, key: str, media_count: Column, dummy: list[int], pad: int = 0, multiple: int = 8, left: bool = False) -> DataFrame:
    """Rows (input_ids, labels) of each batch padded to one length, a multiple of ``multiple``: with attention_mask and positions.

    In a batch without any medium the first row gets the ids of a ``dummy``
    one, masked and without labels, so that every batch runs the vision part.
    Labels are padded with -100. Positions count what is attended; padding
    has position 1.
    """
    whole = Window.partitionBy(batch)
    none = F.max(media_count).over(whole) == 0
    first = F.row_number().over(Window.partitionBy(batch).orderBy(key)) == 1
    extra = F.when(none & first, F.array(*map(F.lit, dummy))).otherwise(F.array().cast("array<int>"))
    with_dummy = rows.withColumn("_x", extra).withColumn("_n", F.size("input_ids"))
    wide = with_dummy.withColumn("input_ids", F.concat("input_ids", "_x")).withColumn("labels", F.concat("labels", F.transform("_x", lambda _: F.lit(IGNORE))))
    attended = F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.transform("_x", lambda _: F.lit(0)))
    sized = wide.withColumn("attention_mask", attended).withColumn("_l", (F.ceil(F.max(F.size("input_ids")).over(whole) / multiple) * multiple).cast("int"))
    done = sized.select(*[c for c in rows.columns if c not in ("input_ids", "labels")], padded(F.col("input_ids"), F.col("_l"), pad, left).alias("input_ids"), padded(F.col("labels"), F.col("_l"), IGNORE, left).alias("labels"), padded(F.col("attention_mask"), F.col("_l"), 0, left).alias("attention_mask"))
    counted = F.aggregate("attention_mask", F.array().cast("array<int>"), lambda s, m: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + m)))
    return done.withColumn("positions", F.transform(F.arrays_zip(counted.alias("c"), F.col("attention_mask").alias("m")), lambda p: F.when(p["m"] == 1, p["c"] - 1).otherwise(1)))


def feedback_batch(rows: DataFrame, batch: str, pad: int = 0, left: bool = False) -> DataFrame:
    """Rows of a feedback stage with their target and mismatched sides, each padded to the longest of its side in the batch, and their tags."""
    whole = Window.partitionBy(batch)
    out = rows
    for prefix in ("", "kl_"):
        n = F.max(F.size(f"{prefix}input_ids")).over(whole)
        out = out.withColumn("_n", n)
        ids, labels = F.col(f"{prefix}input_ids"), F.col(f"{prefix}labels")
        mask = padded(F.transform(ids, lambda _: F.lit(1)), F.col("_n"), 0, left)
        out = out.withColumn(f"{prefix}attention_mask", mask).withColumn(f"{prefix}input_ids", padded(ids, F.col("_n"), pad, left)).withColumn(f"{prefix}labels", padded(labels, F.col("_n"), IGNORE, left))
    return out.drop("_n")


def modality_error(images: Column, videos: Column, audios: Column, accepts: set[str]) -> Column:
    """Why a template that accepts some of image, video and audio can't take a row's media; null if it can."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = F.lit(None).cast("string")
    for name, column in (("audio", audios), ("video", videos), ("image", images)):
        if name not in accepts:
            out = F.when(some(column), f"no {name} input").otherwise(out)
    return out


def check_modalities(rows: DataFrame, columns: dict[str, str], accepts: set[str]) -> None:
    """Raises before anything runs if the table has a media column that the template does not accept."""
    wrong = sorted(name for name, column in columns.items() if column in rows.columns and name not in accepts)
    if wrong:
        raise ValueError(f"this template does not accept {', '.join(wrong)} input; check which template is used")


def vision_windows(grids: DataFrame, key: str, side: int, merge: int = 2) -> DataFrame:
    """The order in which a vision tower with windows takes the merged cells of a row's grids (g, t, h, w): key, place, cell.

    ``grids`` has a row for each grid of a row, numbered by ``g``. Each frame
    is cut into windows of ``side`` merged cells, row by row; cells keep
    their number over all grids of the row.
    """
    cells = grids.withColumn("_h", F.floor(F.col("h") / merge)).withColumn("_w", F.floor(F.col("w") / merge)).withColumn("_n", F.col("t") * F.col("_h") * F.col("_w"))
    before = Window.partitionBy(key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    each = cells.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_c"))
    y, x = F.floor(F.col("_c") / F.col("_w")) % F.col("_h"), F.col("_c") % F.col("_w")
    frame = F.floor(F.col("_c") / (F.col("_h") * F.col("_w")))
    order = Window.partitionBy(key).orderBy("g", frame, F.floor(y / side), F.floor(x / side), y, x)
    return each.select(key, (F.row_number().over(order) - 1).alias("place"), (F.col("_first") + F.col("_c")).alias("cell"))


def window_lengths(t: Column, h: Column, w: Column, side: int, merge: int = 2) -> Column:
    """Sums from 0 of the patches in the windows of one grid, in order; a grid that windows divide evenly still has its padding windows, of length 0."""
    hh, ww = F.floor(h / merge).cast("int"), F.floor(w / merge).cast("int")
    across = lambda n: F.transform(F.sequence(F.lit(0), F.floor(n / side).cast("int")), lambda k: F.least(F.lit(side), n - k * side))
    one = F.flatten(F.transform(across(hh), lambda a: F.transform(across(ww), lambda b: a * b * merge * merge)))
    lengths = F.flatten(F.array_repeat(one, t.cast("int")))
    return F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n.cast("int"))))


def partners(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows drawn with repeats out of all rows for each row, as mosaics take them: key, rank, partner."""
    from geoquarry.operators.mix import draw, numbered

    placed = numbered(rows.select(key), key, "_place")
    size = rows.count()
    drawn = rows.select(key, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).withColumn("_place", F.floor(draw(seed, key, "rank") * size))
    return drawn.join(placed.withColumnRenamed(key, "partner"), "_place").select(key, "rank", "partner")
