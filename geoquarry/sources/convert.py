"""Foreign annotation files as label rows, image-path scans, kinds of sources, and decoders that plug in."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.sources.sinks import short_number

# Endings of image and video files.
IMAGE_ENDINGS = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")
VIDEO_ENDINGS = ("asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv", "webm")


def source_kind(source: object) -> str:
    """stream, screenshot, image, video, list, folder, frame or memory: by which loader a source is read."""
    if isinstance(source, (list, tuple)):
        return "list"
    if isinstance(source, DataFrame):
        return "frame"
    if not isinstance(source, (str, int, os.PathLike)):
        return "memory"
    text = str(source)
    if text.isnumeric() or text.endswith(".streams") or urlparse(text).scheme.lower() in ("rtsp", "rtmp", "http", "https") and not text.lower().rpartition(".")[2] in (*IMAGE_ENDINGS, *VIDEO_ENDINGS):
        return "stream"
    if text.lower().startswith("screen"):
        return "screenshot"
    ending = text.lower().rpartition(".")[2]
    return "image" if ending in IMAGE_ENDINGS else "video" if ending in VIDEO_ENDINGS else "folder"


def from_memory(spark: SparkSession, arrays: list) -> DataFrame:
    """In-memory images (height, width, channels) as rows: frame_id, height, width, channels and raw bytes."""
    rows = [(i, int(a.shape[0]), int(a.shape[1]), int(a.shape[2]) if a.ndim > 2 else 1, a.tobytes()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "frame_id int, height int, width int, channels int, data binary")


def media_files(spark: SparkSession, folder: str, stride: int = 1, frames: Callable[[bytes], list] | None = None) -> DataFrame:
    """Images, then videos, of a folder: path, kind, frame and data. With ``frames``, a decoder, every ``stride``-th frame of a video is a row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = rows.select("path", F.when(ending.isin(*IMAGE_ENDINGS), "image").when(ending.isin(*VIDEO_ENDINGS), "video").alias("kind"), F.col("content").alias("data")).where("kind is not null")
    if frames is None:
        return known.select("path", "kind", F.lit(0).alias("frame"), "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, data in zip(batch["path"], batch["kind"], batch["data"]):
                parts = enumerate(frames(data)) if kind == "video" else [(0, data)]
                out += [(path, kind, i, part) for i, part in parts if i % stride == 0]
            yield pd.DataFrame(out, columns=["path", "kind", "frame", "data"])

    return known.mapInPandas(run, "path string, kind string, frame int, data binary")


def decoded(df: DataFrame, column: str, decode: Callable[[bytes], tuple[int, int, bytes]], out: str = "image") -> DataFrame:
    """Adds ``out`` (width, height, data) from a plugged-in decoder; null where it fails or the data is null."""

    @F.pandas_udf("struct<width:int,height:int,data:binary>")
    def run(values: pd.Series) -> pd.DataFrame:
        got = []
        for v in values:
            try:
                got.append(tuple(decode(v)) if v is not None else (None, None, None))
            except Exception:  # noqa: BLE001 - a broken file is a null, not a failed job
                got.append((None, None, None))
        return pd.DataFrame(got, columns=["width", "height", "data"])

    raw = df.withColumn("_d", run(F.col(column)))
    return raw.withColumn(out, F.when(F.col("_d.data").isNotNull(), F.col("_d"))).drop("_d")


def image_paths(lines: DataFrame, column: str, folder: str, files: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Distinct image paths of JSON lines (value), and the condition under which a line is broken.

    The named field holds a path or a list of paths; relative ones are below
    ``folder``. Broken lines give no path. ``files`` (path), if given, holds
    what exists.
    """
    raw = F.get_json_object("value", f"$.{column}")
    broken = F.try_parse_json("value").isNull() & (F.length(F.trim("value")) > 0)
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(F.length(raw) > 0, F.array(raw))
    each = lines.where(~F.coalesce(broken, F.lit(True))).select(F.explode(listed).alias("p")).where(F.length("p") > 0)
    path = F.when(F.col("p").startswith("/"), F.col("p")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "p"))
    found = each.select(path.alias("path")).distinct()
    return (found if files is None else found.join(files.select("path"), "path", "left_semi")), broken


def drone_labels(lines: DataFrame, width: str, height: str) -> DataFrame:
    """Rows of comma-separated boxes (left, top, width, height, score, class) as class from 0 and normalised centre boxes; ignored regions, score 0, are left out."""
    part = F.split("value", ",")
    at = lambda i: part[i].cast("int")
    rows = lines.where((F.size(part) >= 6) & (F.trim(part[4]) != "0"))
    return rows.select(*[c for c in lines.columns if c not in ("value", width, height)], (at(5) - 1).alias("cls"), ((at(0) + at(2) / 2) / F.col(width)).alias("cx"), ((at(1) + at(3) / 2) / F.col(height)).alias("cy"), (at(2) / F.col(width)).alias("w"), (at(3) / F.col(height)).alias("h"))


def voc_labels(files: DataFrame, xml: str, names: list[str]) -> DataFrame:
    """Objects of XML annotations as class and normalised centre boxes (from 1 in the file); unknown and difficult ones are left out."""
    get = lambda root, path: F.xpath(F.col(xml), F.lit(f"{root}/{path}/text()"))
    size = {k: F.xpath_double(F.col(xml), F.lit(f"//size/{k}")) for k in ("width", "height")}
    each = files.select(*[c for c in files.columns if c != xml], size["width"].alias("_w"), size["height"].alias("_h"), F.explode(F.arrays_zip(*[get("//object", p).alias(n) for n, p in (("name", "name"), ("difficult", "difficult"), ("x1", "bndbox/xmin"), ("x2", "bndbox/xmax"), ("y1", "bndbox/ymin"), ("y2", "bndbox/ymax"))])).alias("o"))
    number = lambda c: F.col(f"o.{c}").cast("double")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("o.name")).cast("int") - 1
    rows = each.where((place >= 0) & (F.coalesce(number("difficult"), F.lit(0.0)) != 1))
    keep = [c for c in files.columns if c != xml]
    return rows.select(*keep, place.alias("cls"), (((number("x1") + number("x2")) / 2 - 1) / F.col("_w")).alias("cx"), (((number("y1") + number("y2")) / 2 - 1) / F.col("_h")).alias("cy"), ((number("x2") - number("x1")) / F.col("_w")).alias("w"), ((number("y2") - number("y1")) / F.col("_h")).alias("h"))


def polygon_line(cls: Column, points: Column, width: Column, height: Column) -> Column:
    """A label line of a polygon, ``points`` an array of (x, y): class and normalised corners with up to six significant digits."""
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", short_number(p["x"] / width), short_number(p["y"] / height))), " "))


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics of a data set as one JSON document a row."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def crop_boxes(image: bytes, height: int, width: int, channels: int, boxes: list[tuple[int, int, int, int]]) -> list[bytes]:
    """Raw bytes of the boxes cut out of a raw image."""
    import numpy as np

    a = np.frombuffer(image, np.uint8).reshape(height, width, channels)
    return [a[max(0, y1) : y2, max(0, x1) : x2].tobytes() for x1, y1, x2, y2 in boxes]
