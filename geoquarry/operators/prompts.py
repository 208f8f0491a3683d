"""Choosing among the masks of an image by box, point or text, and cleaning mask sets up.

Masks are rows (image_id, mask_id, y, x), a row for each pixel, so all of it
is joins and aggregates; no mask is ever held as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.operators.kernels import suppress, without_small


def mask_boxes(masks: DataFrame, least: int = 0) -> DataFrame:
    """image_id, mask_id, area and box of each mask of at least ``least`` pixels; the far corners are exclusive."""
    grouped = masks.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
    return grouped.where(F.col("area") >= least)


def by_box(masks: DataFrame, prompts: DataFrame, height: int, width: int) -> DataFrame:
    """The mask of greatest overlap for each box prompt (image_id, prompt_id, corners): image_id, prompt_id, mask_id, iou.

    Corners are rounded and held inside the image. Of equal overlaps the
    mask that comes first wins, as it does where no mask meets the box.
    """
    hold = lambda c, most: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(most)))
    boxes = prompts.select("image_id", "prompt_id", hold("x1", width).alias("_x1"), hold("y1", height).alias("_y1"), hold("x2", width).alias("_x2"), hold("y2", height).alias("_y2"))
    inside = (F.col("x") >= F.col("_x1")) & (F.col("x") < F.col("_x2")) & (F.col("y") >= F.col("_y1")) & (F.col("y") < F.col("_y2"))
    sizes = masks.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("_area"))
    met = masks.join(boxes, "image_id").where(inside).groupBy("image_id", "prompt_id", "mask_id").agg(F.count(F.lit(1)).alias("_n"))
    pairs = boxes.join(sizes, "image_id").join(met, ["image_id", "prompt_id", "mask_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    box = (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    scored = pairs.withColumn("iou", F.col("_n") / (box + F.col("_area") - F.col("_n")))
    best = scored.groupBy("image_id", "prompt_id").agg(F.max(F.struct("iou", (-F.col("mask_id")).alias("_m"))).alias("_b"))
    return best.select("image_id", "prompt_id", (-F.col("_b._m")).alias("mask_id"), F.col("_b.iou").alias("iou"))


def by_points(masks: DataFrame, points: DataFrame) -> DataFrame:
    """The pixels that points (image_id, point_id, y, x, wanted) paint: image_id, y, x.

    Masks are painted from the largest to the smallest, ties in their order;
    one that holds a wanted point is painted, one that holds an unwanted
    point is wiped, the last of its points deciding. The last mask over a
    pixel decides it.
    """
    sizes = masks.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("_area"))
    hit = masks.join(points, ["image_id", "y", "x"]).groupBy("image_id", "mask_id").agg(F.max_by("wanted", "point_id").alias("_w"))
    painted = masks.join(hit, ["image_id", "mask_id"]).join(sizes, ["image_id", "mask_id"])
    final = painted.groupBy("image_id", "y", "x").agg(F.max_by("_w", F.struct(-F.col("_area"), "mask_id")).alias("_w"))
    return final.where(F.col("_w") == 1).select("image_id", "y", "x")


def by_text(sizes: DataFrame, scores: DataFrame, least: int = 100) -> DataFrame:
    """The place among all masks that a text's scores choose: image_id and chosen.

    ``sizes`` has the place (from 0) and area of every mask, ``scores`` the
    score of the masks above ``least`` pixels by place. The best of those
    masks is known by its rank among them; to it come the small masks
    whose place is not above that rank.
    """
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("place")) - 1
    large = sizes.where(F.col("area") > least).withColumn("_rank", rank)
    best = large.join(scores, ["image_id", "place"]).groupBy("image_id").agg(F.max(F.struct("score", "_rank")).alias("_b")).select("image_id", F.col("_b._rank").alias("_rank"))
    small = sizes.where(F.col("area") <= least).select("image_id", F.col("place").alias("_place"))
    passed = best.join(small, "image_id", "left").groupBy("image_id", "_rank").agg(F.count_if(F.col("_place") <= F.col("_rank")).alias("_n"))
    return passed.select("image_id", (F.col("_rank") + F.col("_n")).alias("chosen"))


def between_crops(boxes: DataFrame, limit: float = 0.7) -> DataFrame:
    """Suppression over the boxes (det_id, corners, crop_area) that all crops of an image gave; small crops are preferred."""
    rows = boxes.select("image_id", "det_id", "x1", "y1", "x2", "y2", "crop_area")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("det_id").reset_index(drop=True)
        kept = suppress(group[["x1", "y1", "x2", "y2"]].to_numpy(float), 1 / group["crop_area"].to_numpy(float), limit)
        return group.iloc[kept]

    return rows.groupBy("image_id").applyInPandas(run, rows.schema)


def cleaned(masks: DataFrame, height: int, width: int, least: int, limit: float = 0.7) -> DataFrame:
    """Masks without small holes and islands, and without those that then overlap another by more than ``limit`` in their boxes.

    Masks that needed no change are preferred. Returns image_id, mask_id, changed, y, x.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, boxes, scores = [], [], []
        for mask_id, rows in group.groupby("mask_id", sort=True):
            mask = np.zeros((height, width), bool)
            mask[rows["y"].to_numpy(), rows["x"].to_numpy()] = True
            mask, holes = without_small(mask, least, "holes")
            mask, islands = without_small(mask, least, "islands")
            ys, xs = np.nonzero(mask)
            boxes.append((xs.min(), ys.min(), xs.max(), ys.max()) if len(xs) else (0, 0, 0, 0))
            scores.append(0.0 if holes or islands else 1.0)
            out.append((mask_id, holes or islands, ys, xs))
        kept = suppress(np.array(boxes, float), np.array(scores), limit) if boxes else []
        parts = [pd.DataFrame({"image_id": group["image_id"].iloc[0], "mask_id": m, "changed": bool(c), "y": ys, "x": xs}) for m, c, ys, xs in (out[i] for i in kept)]
        return pd.concat(parts) if parts else pd.DataFrame({"image_id": [], "mask_id": [], "changed": [], "y": [], "x": []})

    kinds = {n: t.simpleString() for n, t in ((f.name, f.dataType) for f in masks.schema)}
    return masks.select("image_id", "mask_id", "y", "x").groupBy("image_id").applyInPandas(run, f"image_id {kinds['image_id']}, mask_id {kinds['mask_id']}, changed boolean, y int, x int")


def patches(pixels: DataFrame, colours: list[str], size: int = 32) -> DataFrame:
    """image_id, region and values (channel, row, column in one list): every region cut out, padded to a square and resized.

    What is not of the region is 0; the padding goes to both sides, the odd
    pixel to the far one; resizing is bilinear between pixel centres.
    """

    def resized(square: np.ndarray) -> np.ndarray:
        n = square.shape[1]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, None)
        low = np.minimum(at.astype(int), n - 1)
        high, part = np.minimum(low + 1, n - 1), at - low
        rows = square[:, low] * (1 - part)[None, :, None] + square[:, high] * part[None, :, None]
        return rows[:, :, low] * (1 - part) + rows[:, :, high] * part

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, x = p["y"].to_numpy(), p["x"].to_numpy()
        h, w = y.max() - y.min() + 1, x.max() - x.min() + 1
        side = max(h, w)
        square = np.zeros((len(colours), side, side))
        square[:, y - y.min() + (side - h) // 2, x - x.min() + (side - w) // 2] = p[colours].to_numpy(float).T
        return pd.DataFrame({"image_id": [p["image_id"].iloc[0]], "region": [p["label"].iloc[0]], "values": [resized(square).ravel()]})

    rows = pixels.where("label >= 0").select("image_id", "label", "y", "x", *colours)
    return rows.groupBy("image_id", "label").applyInPandas(run, "image_id bigint, region int, values array<double>")


def write_patches(table: DataFrame, folder: str, size: int, channels: int) -> None:
    """Every patch as a PNG of eight bits a channel in a folder of its image, written where the rows are."""

    def write(rows) -> None:
        import struct
        import zlib
        from pathlib import Path

        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        for r in rows:
            values = np.clip(np.rint(np.array(r["values"]).reshape(channels, size, size) * 255), 0, 255).astype(np.uint8)
            lines = np.concatenate([np.zeros((size, 1), np.uint8), values.transpose(1, 2, 0).reshape(size, -1)], axis=1)
            head = struct.pack(">IIBBBBB", size, size, 8, 2 if channels == 3 else 0, 0, 0, 0)
            path = Path(folder) / str(r["image_id"])
            path.mkdir(parents=True, exist_ok=True)
            (path / f"{r['region']}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))

    table.foreachPartition(write)
