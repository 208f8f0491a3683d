"""Text, JSON and CSV sinks for detections, predictions, scores and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_number(value: Column) -> Column:
    """A number with up to six significant digits and no zeros at its end, as C's %g writes it."""
    text = F.format_string("%.6g", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def label_line(cls: Column, cx: Column, cy: Column, w: Column, h: Column, conf: Column | None = None) -> Column:
    """One label line: class and normalised centre box with up to six significant digits, confidence last if given."""
    parts = [short_number(c) for c in (cx, cy, w, h, *([conf] if conf is not None else []))]
    return F.concat_ws(" ", cls.cast("string"), *parts)


def prediction_json(image_id: Column, cls: Column, x1: Column, y1: Column, x2: Column, y2: Column, score: Column) -> Column:
    """A COCO-style prediction: box as left, top, width and height to three digits, score to five."""
    box = F.array(*[F.round(c, 3) for c in (x1, y1, x2 - x1, y2 - y1)])
    return F.to_json(F.struct(image_id.alias("image_id"), cls.alias("category_id"), box.alias("bbox"), F.round(score, 5).alias("score")))


def detection_json(cls: Column, name: Column, conf: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """A detection as JSON, its box divided by the image's size if that is given."""
    w, h = (width if width is not None else F.lit(1.0)), (height if height is not None else F.lit(1.0))
    box = F.struct((x1 / w).alias("x1"), (y1 / h).alias("y1"), (x2 / w).alias("x2"), (y2 / h).alias("y2"))
    return F.to_json(F.struct(name.alias("name"), cls.alias("class"), conf.alias("confidence"), box.alias("box")))


def pads_last(ids: Column, pad: int) -> Column:
    """Moves the pads at the beginning of generated ids to their end."""
    first = F.array_position(F.transform(ids, lambda x: x != pad), True).cast("int")
    return F.when(first == 0, ids).otherwise(F.concat(F.slice(ids, first, F.size(ids)), F.slice(ids, F.lit(1), first - 1)))


def write_predictions(df: DataFrame, path: str, order: str | None = None) -> None:
    """prompt, predict and label as JSON lines."""
    (df.sortWithinPartitions(order) if order else df).select("prompt", "predict", "label").write.mode("overwrite").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    """chosen and rejected rewards, rounded to two digits."""
    df.select(F.round("chosen", 2).alias("chosen"), F.round("rejected", 2).alias("rejected")).write.mode("overwrite").json(path)


def write_table(df: DataFrame, folder: str, columns: list[str]) -> None:
    """One result as JSON lines and as CSV with a fixed header; a single table needs no merging of ranks."""
    df.select(*columns).write.mode("overwrite").json(f"{folder}/json")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_labels(df: DataFrame, path: str, image: str, line: str) -> None:
    """Label lines as text, a folder for each image."""
    df.select(image, F.col(line).alias("value")).write.mode("overwrite").partitionBy(image).text(path)
