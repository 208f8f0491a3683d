"""Region graphs of label rasters: adjacency, features, heat diffusion, merging, sizes, descriptors.

Pixels are rows (image_id, y, x, label, v..): one image is the unit of
parallelism, and every window or join is inside an image. A negative label
means unassigned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.operators.kernels import components, kmeans
from geoquarry.storage import materialize


def adjacency(pixels: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) between the labels of right and lower neighbours, each once."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    beside = pixels.select("image_id", "y", "x", "label", F.lead("label").over(row).alias("right"), F.lead("x").over(row).alias("_rx"), F.lead("label").over(column).alias("down"), F.lead("y").over(column).alias("_dy"))
    near = F.array(F.when(F.col("_rx") == F.col("x") + 1, F.col("right")), F.when(F.col("_dy") == F.col("y") + 1, F.col("down")))
    pairs = beside.select("image_id", "label", F.explode(near).alias("other")).where("label >= 0 and other >= 0 and label <> other")
    return pairs.select("image_id", F.least("label", "other").alias("src"), F.greatest("label", "other").alias("dst")).distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("image_id", "src", "dst").unionByName(edges.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def features(pixels: DataFrame, colours: list[str], gradient: str | None = None) -> DataFrame:
    """Size, mean colours and mean gradient (complexity) of each region."""
    means = [F.avg(c).alias(c) for c in colours]
    extra = [F.avg(gradient).alias("complexity")] if gradient else []
    return pixels.where("label >= 0").groupBy("image_id", F.col("label").alias("region")).agg(F.count(F.lit(1)).alias("size"), *means, *extra)


def centres(pixels: DataFrame, colours: list[str]) -> DataFrame:
    """Mean colours and mean place of each region."""
    return pixels.where("label >= 0").groupBy("image_id", F.col("label").alias("region")).agg(*[F.avg(c).alias(c) for c in (*colours, "y", "x")], F.count(F.lit(1)).alias("size"))


def boxes(pixels: DataFrame) -> DataFrame:
    """Box of each region in whole pixels."""
    return pixels.where("label >= 0").groupBy("image_id", F.col("label").alias("region")).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the columns of both ends, prefixed by s_ and d_."""
    end = lambda p, k: nodes.select("image_id", F.col("region").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(end("s", "src"), ["image_id", "src"]).join(end("d", "dst"), ["image_id", "dst"])


def distance(colours: list[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"s_{c}") - F.col(f"d_{c}"), 2) for c in colours[1:]), F.pow(F.col(f"s_{colours[0]}") - F.col(f"d_{colours[0]}"), 2)))


def temperatures(nodes: DataFrame, edges: DataFrame, colours: list[str], sigma: float) -> DataFrame:
    """Mean of exp(-distance / sigma) to the neighbours, 0 for a region without any."""
    both = with_ends(mirrored(edges), nodes, colours)
    heat = both.groupBy("image_id", F.col("src").alias("region")).agg(F.avg(F.exp(-distance(colours) / sigma)).alias("temp"))
    return nodes.join(heat, ["image_id", "region"], "left").fillna(0.0, ["temp"])


def conductivity(nodes: DataFrame, edges: DataFrame, colours: list[str], k0: float, sigma: float, alpha: float) -> DataFrame:
    """Edges with k = k0 exp(-distance^2 / 2 sigma^2) (1 + alpha min(complexities))."""
    both = with_ends(edges, nodes, [*colours, "complexity"])
    d = distance(colours)
    k = k0 * F.exp(-d * d / (2 * sigma * sigma)) * (1 + alpha * F.least("s_complexity", "d_complexity"))
    return both.select("image_id", "src", "dst", k.alias("k"))


def diffuse_once(heat: DataFrame, conductive: DataFrame, dt: float) -> DataFrame:
    """One step T + dt (K T - T deg) of all images; ``change`` is the step's size."""
    both = conductive.select("image_id", "src", "dst", "k").unionByName(conductive.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "k"))
    neighbours = heat.select("image_id", F.col("region").alias("dst"), F.col("temp").alias("_t"))
    flow = both.join(neighbours, ["image_id", "dst"]).groupBy("image_id", F.col("src").alias("region")).agg(F.sum(F.col("k") * F.col("_t")).alias("_in"), F.sum("k").alias("_deg"))
    step = dt * (F.coalesce("_in", F.lit(0.0)) - F.col("temp") * F.coalesce("_deg", F.lit(0.0)))
    return heat.join(flow, ["image_id", "region"], "left").select("image_id", "region", (F.col("temp") + step).alias("temp"), F.abs(step).alias("change"))


def diffuse_tables(heat: DataFrame, conductive: DataFrame, dt: float, steps: int, still: float = 1e-5) -> DataFrame:
    """Steps over tables, written every time so that lineage stays short; an image that is still keeps its last temperatures."""
    now = heat.select("image_id", "region", "temp")
    for _ in range(steps):
        moved = materialize(diffuse_once(now, conductive, dt), "heat")
        moving = moved.groupBy("image_id").agg((F.max("change") >= still).alias("_go"))
        now = moved.join(now.withColumnRenamed("temp", "_was"), ["image_id", "region"]).join(moving, "image_id").select("image_id", "region", F.when(F.col("_go"), F.col("temp")).otherwise(F.col("_was")).alias("temp"))
        if not moving.where("_go").take(1):
            break
    return now


def diffuse_arrays(temps: np.ndarray, src: np.ndarray, dst: np.ndarray, k: np.ndarray, dt: float, steps: int, still: float = 1e-5) -> np.ndarray:
    """The same for one image; on convergence the last step is not applied."""
    n = len(temps)
    deg = np.bincount(src, k, n) + np.bincount(dst, k, n)
    for _ in range(steps):
        flow = np.bincount(src, k * temps[dst], n) + np.bincount(dst, k * temps[src], n)
        step = dt * (flow - temps * deg)
        if np.abs(step).max(initial=0.0) < still:
            break
        temps = temps + step
    return temps


def union_find(n: int, pairs) -> np.ndarray:
    """Smallest member of each element's set."""
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def per_image(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("image_id").applyInPandas(run, schema)


def _keyed(edges: DataFrame):
    """Groups edges by image under a name of their own, as they may stem from the table they are grouped with."""
    return edges.withColumnRenamed("image_id", "_image").groupBy("_image")


def diffuse(nodes: DataFrame, conductive: DataFrame, dt: float, steps: int) -> DataFrame:
    """Temperatures after up to ``steps`` steps, one image at a time: image_id, region, temp."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("region").reset_index(drop=True)
        place = {r: i for i, r in enumerate(n["region"])}
        src, dst = (e[c].map(place).to_numpy(int) if len(e) else np.zeros(0, int) for c in ("src", "dst"))
        n["temp"] = diffuse_arrays(n["temp"].to_numpy(float), src, dst, e["k"].to_numpy(float), dt, steps)
        return n[["image_id", "region", "temp"]]

    return nodes.select("image_id", "region", "temp").groupBy("image_id").cogroup(_keyed(conductive)).applyInPandas(run, "image_id bigint, region int, temp double")


def merge(heat: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Regions joined over edges whose temperatures differ by less than ``least``: image_id, region, merged (from 0 in order)."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("region").reset_index(drop=True)
        place = {r: i for i, r in enumerate(n["region"])}
        t = n["temp"].to_numpy(float)
        pairs = [(place[a], place[b]) for a, b in zip(e["src"], e["dst"]) if abs(t[place[a]] - t[place[b]]) < least]
        n["merged"] = np.unique(union_find(len(n), pairs), return_inverse=True)[1].astype(np.int32)
        return n[["image_id", "region", "merged"]]

    return heat.select("image_id", "region", "temp").groupBy("image_id").cogroup(_keyed(edges)).applyInPandas(run, "image_id bigint, region int, merged int")


def relabel(pixels: DataFrame, merged: DataFrame) -> DataFrame:
    """Pixels under their merged labels; unassigned ones stay -1."""
    lut = merged.select("image_id", F.col("region").alias("label"), F.col("merged").alias("_m"))
    return pixels.join(lut, ["image_id", "label"], "left").withColumn("label", F.coalesce("_m", F.lit(-1))).drop("_m")


def fill_unassigned(pixels: DataFrame) -> DataFrame:
    """Unassigned pixels take the label of the nearest assigned one, ties by row, then column: image_id, y, x, label."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"]).reset_index(drop=True)
        y, x, label = (p[c].to_numpy() for c in ("y", "x", "label"))
        gaps = np.flatnonzero(label < 0)
        if 0 < len(gaps) < len(label):
            p["label"] = nearest_labels(y, x, label)
        return p

    return per_image(pixels.select("image_id", "y", "x", "label"), run, "image_id bigint, y int, x int, label int")


def nearest_labels(y: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of pixels, those without one taking the nearest one's; ties by row, then column.

    For every place of a row the nearest labelled column of that row is
    found by two running maxima; a gap then compares one place a row. An
    image of h rows and w columns takes h * h * w steps, in numpy.
    """
    y, x = y - y.min(), x - x.min()
    h, w = int(y.max()) + 1, int(x.max()) + 1
    grid = np.full((h, w), -1)
    grid[y, x] = label
    known, columns = grid >= 0, np.arange(w)
    before = np.maximum.accumulate(np.where(known, columns, -(10**6)), axis=1)
    after = np.minimum.accumulate(np.where(known, columns, 10**6)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(columns - before <= after - columns, before, after)
    apart = (near - columns).astype(np.int64) ** 2
    out, rows = label.copy(), np.arange(h)
    missing = label < 0
    for column in np.unique(x[missing]):
        at = np.flatnonzero(missing & (x == column))
        best = ((y[at][:, None] - rows[None]) ** 2 + apart[:, column][None]).argmin(1)
        out[at] = grid[best, near[best, column]]
    return out


def min_size_round(pixels: DataFrame, colours: list[str], least: int) -> DataFrame:
    """For each small region the neighbour it merges into: the one of nearest colour that isn't small, ties by number."""
    nodes = features(pixels, colours)
    both = with_ends(mirrored(adjacency(pixels)), nodes, ["size", *colours]).where((F.col("s_size") < least) & (F.col("d_size") >= least))
    w = Window.partitionBy("image_id", "src").orderBy("_d", "dst")
    return both.withColumn("_d", distance(colours)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("image_id", F.col("src").alias("region"), F.col("dst").alias("target"))


def enforce_min_size(pixels: DataFrame, colours: list[str], least: int, rounds: int = 5) -> DataFrame:
    """Merges small regions in up to ``rounds`` rounds, until none has a target; labels are renumbered from 0."""
    for _ in range(rounds):
        moves = materialize(min_size_round(pixels, colours, least), "moves")
        if not moves.take(1):
            break
        lut = moves.select("image_id", F.col("region").alias("label"), F.col("target").alias("_t"))
        pixels = materialize(pixels.join(lut, ["image_id", "label"], "left").withColumn("label", F.coalesce("_t", "label")).drop("_t"), "pixels")
    return pixels.withColumn("label", F.when(F.col("label") >= 0, F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.col("label") < 0, "label")) - 1).otherwise(F.col("label")))


def split_large(pixels: DataFrame, most: int, target: int) -> DataFrame:
    """Regions above ``most`` pixels are cut by k-means on their places into about ``target`` pixels each; new labels follow the greatest."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"]).reset_index(drop=True)
        labels = p["label"].to_numpy().copy()
        following = labels.max() + 1 if len(labels) else 0
        for region in np.unique(labels[labels >= 0]):
            at = np.flatnonzero(labels == region)
            if len(at) > most:
                parts = kmeans(p.loc[at, ["y", "x"]].to_numpy(float), max(2, round(len(at) / target)))
                labels[at] = following + np.unique(parts, return_inverse=True)[1]
                following = labels.max() + 1
        p["label"] = labels
        return p

    return per_image(pixels.select("image_id", "y", "x", "label"), run, "image_id bigint, y int, x int, label int")


def gaussians(pixels: DataFrame) -> DataFrame:
    """Mean, population deviation and correlation of each region's places; a single pixel has deviations of 0.001."""
    var = lambda c: F.greatest(F.var_pop(c), F.lit(1e-6))
    return (
        pixels.where("label >= 0")
        .groupBy("image_id", F.col("label").alias("region"))
        .agg(F.avg("x").alias("mu_x"), F.avg("y").alias("mu_y"), F.sqrt(var("x")).alias("sigma_x"), F.sqrt(var("y")).alias("sigma_y"), F.covar_pop("x", "y").alias("_c"), F.count(F.lit(1)).alias("size"))
        .withColumn("rho", F.greatest(F.least(F.col("_c") / (F.col("sigma_x") * F.col("sigma_y")), F.lit(0.999)), F.lit(-0.999)))
        .drop("_c")
    )


def paint(masks: DataFrame) -> DataFrame:
    """Label map of overlapping masks (image_id, mask_id, area, y, x): the larger mask covers the smaller, ties the later; labels from 0 in order of area."""
    sized = masks.select("image_id", "mask_id", "area").distinct()
    ranked = sized.withColumn("_l", F.row_number().over(Window.partitionBy("image_id").orderBy("area", "mask_id")) - 1)
    return masks.join(ranked, ["image_id", "mask_id", "area"]).groupBy("image_id", "y", "x").agg(F.max("_l").cast("int").alias("label"))


def covered_masks(masks: DataFrame, part: float = 0.8) -> DataFrame:
    """Masks without those of which more than ``part`` lies in a larger one of the same image."""
    sized = masks.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area"))
    own = masks.select("image_id", "mask_id", "y", "x").join(sized, ["image_id", "mask_id"])
    other = own.select("image_id", "y", "x", F.col("mask_id").alias("_m"), F.col("area").alias("_a"))
    shared = own.join(other, ["image_id", "y", "x"]).where(F.col("_a") > F.col("area")).groupBy("image_id", "mask_id", "_m").agg(F.count(F.lit(1)).alias("_n"), F.first("area").alias("area"))
    drop = shared.where(F.col("_n") / F.col("area") > part).select("image_id", "mask_id").distinct()
    return masks.join(drop, ["image_id", "mask_id"], "left_anti")


def mask_ious(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of all pairs of masks (image_id, mask_id, y, x) of an image that share a pixel."""
    size = lambda m, n: m.groupBy("image_id", F.col("mask_id").alias(n)).agg(F.count(F.lit(1)).alias(f"_{n}"))
    both = a.select("image_id", "y", "x", F.col("mask_id").alias("a")).join(b.select("image_id", "y", "x", F.col("mask_id").alias("b")), ["image_id", "y", "x"])
    shared = both.groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    joined = shared.join(size(a, "a"), ["image_id", "a"]).join(size(b, "b"), ["image_id", "b"])
    return joined.select("image_id", "a", "b", (F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n") + 1e-7)).alias("iou"))


def stability(logits: DataFrame, mask: list[str], value: str, limit: float = 0.0, offset: float = 1.0) -> DataFrame:
    """Pixels above limit + offset over pixels above limit - offset, for each mask."""
    return logits.groupBy(*mask).agg((F.count_if(F.col(value) > limit + offset) / F.expr(f"nullif(count_if({value} > {limit - offset}), 0)")).alias("stability"))


def gradient(pixels: DataFrame, value: str) -> DataFrame:
    """Sobel magnitude with zeros beyond the border, for dense images: adds ``grad``."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    at = lambda c, w, k: F.coalesce((F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w), F.lit(0.0))
    v = pixels.withColumn("_h", at(value, row, 1) - at(value, row, -1)).withColumn("_s", at(value, row, 1) + 2 * F.col(value) + at(value, row, -1))
    column = Window.partitionBy("image_id", "x").orderBy("y")
    gx = at("_h", column, -1) + 2 * F.col("_h") + at("_h", column, 1)
    gy = at("_s", column, 1) - at("_s", column, -1)
    return v.withColumn("_gx", gx).withColumn("_gy", gy).withColumn("grad", F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)).drop("_h", "_s", "_gx", "_gy")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) of sRGB values of 0..1."""
    linear = lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)
    r, g, b = linear(r), linear(g), linear(b)
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def background_regions(mask: np.ndarray, kernel: int = 3) -> np.ndarray:
    """Background of a label map, opened with a square kernel and numbered by 8-connected component; 0 elsewhere."""
    free = mask < 0

    def spread(m: np.ndarray, grow: bool) -> np.ndarray:
        k = kernel // 2
        wide = np.pad(m, k, constant_values=not grow)
        views = [wide[i : i + m.shape[0], j : j + m.shape[1]] for i in range(kernel) for j in range(kernel)]
        return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)

    return components(spread(spread(free, False), True))


def pipeline(pixels: DataFrame, colours: list[str], sigma_t: float = 1.0, k0: float = 1.0, sigma_c: float = 1.0, alpha: float = 0.1, dt: float = 0.1, steps: int = 10, least: float = 0.05, min_size: int = 2, max_size: int = 48, target: int = 16) -> DataFrame:
    """A label raster to merged regions with Gaussian descriptors: fill, features, graph, diffusion, merging, size limits."""
    grad = gradient(pixels, colours[0])
    filled = materialize(fill_unassigned(pixels).join(grad.drop("label"), ["image_id", "y", "x"]), "filled")
    edges = materialize(adjacency(filled), "edges")
    nodes = materialize(temperatures(features(filled, colours, "grad"), edges, colours, sigma_t), "nodes")
    heat = diffuse(nodes, conductivity(nodes, edges, colours, k0, sigma_c, alpha), dt, steps)
    merged = materialize(relabel(filled, merge(heat, edges, least)), "merged")
    return gaussians(split_large(enforce_min_size(merged, colours, min_size), max_size, target))
