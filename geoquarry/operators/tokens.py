"""Position tokens of regions and grids, and the ordered folds over token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquarry.functions.geometry import orientation, quantize

STEPS = 4095


def region_tokens(described: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """One semantic token for each Gaussian: centre and extent quantised, and its orientation."""
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    extent = lambda s, n: quantize(F.least(F.greatest(2 * s / n, F.lit(0.0)), F.lit(1.0)))
    return described.select(
        "image_id",
        (F.row_number().over(Window.partitionBy("image_id").orderBy("region")) - 1).alias("token_idx"),
        F.lit("semantic").alias("kind"),
        quantize(F.col("mu_y") / h).alias("pos_y"),
        quantize(F.col("mu_x") / w).alias("pos_x"),
        extent(F.col("sigma_y"), h).alias("ext_y"),
        extent(F.col("sigma_x"), w).alias("ext_x"),
        orientation(F.col("sigma_x"), F.col("sigma_y"), F.col("rho")).alias("phi"),
    )


def padded(tokens: DataFrame, merge: int = 4) -> DataFrame:
    """Fills each image up to a multiple of ``merge`` tokens; the filling sits in the centre, without extent."""
    counts = tokens.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    missing = counts.withColumn("_m", (F.ceil(F.col("_n") / merge) * merge - F.col("_n")).cast("int")).where("_m > 0")
    extra = missing.select("image_id", F.explode(F.sequence(F.col("_n"), F.col("_n") + F.col("_m") - 1)).alias("token_idx"))
    half = quantize(F.lit(0.5))
    filling = extra.select("image_id", F.col("token_idx").cast("int").alias("token_idx"), F.lit("padding").alias("kind"), half.alias("pos_y"), half.alias("pos_x"), F.lit(0).alias("ext_y"), F.lit(0).alias("ext_x"), F.lit(0.0).alias("phi"))
    return tokens.unionByName(filling)


def grid_tokens(images: DataFrame, rows: Column, cols: Column, kind: str = "global") -> DataFrame:
    """Centres of a grid over each image, row by row; global tokens take their centre as extent, tiles one cell."""
    cells = images.select("*", rows.cast("int").alias("_r"), cols.cast("int").alias("_c")).where("_r > 0 and _c > 0")
    each = cells.select("image_id", "_r", "_c", F.explode(F.sequence(F.lit(0), F.col("_r") * F.col("_c") - 1)).alias("token_idx"))
    i, j = F.floor(F.col("token_idx") / F.col("_c")), F.col("token_idx") % F.col("_c")
    y, x = quantize((i + 0.5) / F.col("_r")), quantize((j + 0.5) / F.col("_c"))
    ey, ex = (y, x) if kind == "global" else (quantize(1 / F.col("_r")), quantize(1 / F.col("_c")))
    return each.select("image_id", "token_idx", F.lit(kind).alias("kind"), y.alias("pos_y"), x.alias("pos_x"), ey.alias("ext_y"), ex.alias("ext_x"), F.lit(0.0).alias("phi"))


def tile_tokens(images: DataFrame, width: str, height: str, tile: int = 56, patch: int = 14) -> DataFrame:
    """Tiles of a size rounded up to whole patches, as tokens."""
    size = -(-tile // patch) * patch
    return grid_tokens(images, F.ceil(F.col(height) / size), F.ceil(F.col(width) / size), "tile")


def with_fallback(computed: DataFrame, cached: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tokens of each image from the cache, else computed, else tiles; ``provenance`` says from where."""
    a = cached.withColumn("provenance", F.lit("cache"))
    b = computed.join(cached.select("image_id").distinct(), "image_id", "left_anti").withColumn("provenance", F.lit("computed"))
    first = a.unionByName(b)
    c = tiles.join(first.select("image_id").distinct(), "image_id", "left_anti").withColumn("provenance", F.lit("tiles"))
    return first.unionByName(c)


def token_counts(tokens: DataFrame, merge: int = 4) -> DataFrame:
    """Tokens an image takes after merging, by kind and in all; the total is floored as one."""
    of = lambda k: F.floor(F.count_if(F.col("kind") == k) / merge).cast("int")
    return tokens.groupBy("image_id").agg(of("global").alias("n_global"), F.floor(F.count_if(F.col("kind") != "global") / merge).cast("int").alias("n_semantic"), F.floor(F.count(F.lit(1)) / merge).cast("int").alias("n_total"))


def cache_quality(tokens: DataFrame) -> DataFrame:
    """Cached token sets that can be used: global positions spread at most 0.4, extents 0.01, and no more distinct places than patches allow."""
    unit = lambda c: F.when(F.col("kind") == "global", F.col(c) / STEPS)
    checks = tokens.groupBy("image_id").agg(
        F.stddev_pop(unit("pos_y")).alias("spread_y"), F.stddev_pop(unit("pos_x")).alias("spread_x"), F.count_distinct(F.when(F.col("kind") == "semantic", F.struct("pos_y", "pos_x"))).alias("places"), F.count_if(F.col("kind") == "semantic").alias("patches")
    )
    fits = (F.coalesce(F.greatest("spread_y", "spread_x"), F.lit(0.0)) <= 0.4) & (F.col("places") <= 2 * F.col("patches"))
    return checks.withColumn("usable", fits)


def rotary_weights(tokens: DataFrame, dims: int = 16, theta: float = 10000.0) -> DataFrame:
    """Cosine weights of each token's vertical axis: E_m = a_m cos(w_m c) + b_m cos(w_m e), a_m = 1 - m / (dims/2 - 1), b_m = 1 - a_m.

    Centre and extent are turned by the token's angle first; w_m is theta^(-2m/dims).
    """
    half = dims // 2
    turn = lambda y, x: F.col(y) * F.cos("phi") + F.col(x) * F.sin("phi")
    turned = tokens.withColumn("_c", turn("pos_y", "pos_x")).withColumn("_e", turn("ext_y", "ext_x"))
    parts = []
    for m in range(half):
        a, w = 1 - m / max(1, half - 1), theta ** (-2 * m / dims)
        parts.append(F.lit(a) * F.cos(F.col("_c") * w) + F.lit(1 - a) * F.cos(F.col("_e") * w))
    return turned.withColumn("weights", F.array(*parts)).drop("_c", "_e")


def token_descriptors(ids: DataFrame, tokens: DataFrame, image_token: int, n_global: int) -> DataFrame:
    """Each image token of a sequence with its descriptor: tokens after the global ones, in order. ``ids`` has image_id and input_ids."""
    places = ids.select("image_id", F.posexplode("input_ids").alias("pos", "_id")).where(F.col("_id") == image_token)
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("pos")) - 1
    return places.select("image_id", "pos", (order - n_global).alias("token_idx")).where("token_idx >= 0").join(tokens, ["image_id", "token_idx"])


def vision_positions(segments: Column) -> Column:
    """3-D positions of a sequence of segments (kind, n, t, h, w): text runs count on, vision runs lay out a grid, what follows starts above its greatest position.

    Returns an array of (t, h, w); an ordered fold over the segments of a row.
    """
    start = F.struct(F.array().cast("array<struct<t:int,h:int,w:int>>").alias("out"), F.lit(0).alias("next"))

    def step(s: Column, g: Column) -> Column:
        text = F.transform(F.sequence(F.lit(0), g["n"] - 1), lambda i: F.struct(*[(s["next"] + i).cast("int").alias(c) for c in "thw"]))
        hw = g["h"] * g["w"]
        grid = F.transform(
            F.sequence(F.lit(0), g["t"] * hw - 1),
            lambda i: F.struct((s["next"] + F.floor(i / hw) * g["step"]).cast("int").alias("t"), (s["next"] + F.floor((i % hw) / g["w"])).cast("int").alias("h"), (s["next"] + i % g["w"]).cast("int").alias("w")),
        )
        is_text = g["kind"] == "text"
        added = F.when(is_text, F.when(g["n"] > 0, text).otherwise(F.array().cast("array<struct<t:int,h:int,w:int>>"))).otherwise(grid)
        top = F.when(is_text, s["next"] + g["n"]).otherwise(s["next"] + F.greatest((g["t"] - 1) * g["step"], g["h"] - 1, g["w"] - 1) + 1)
        return F.struct(F.concat(s["out"], added).alias("out"), top.cast("int").alias("next"))

    return F.aggregate(segments, start, step, lambda s: s["out"])


def runs_of(ids: Column, token: int) -> Column:
    """Begin and length of each run of ``token`` in an array of ids."""
    state = F.struct(F.array().cast("array<struct<begin:int,n:int>>").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("len"))
    close = lambda s: F.when(s["len"] > 0, F.concat(s["out"], F.array(F.struct((s["at"] - s["len"]).cast("int").alias("begin"), s["len"].cast("int").alias("n"))))).otherwise(s["out"])

    def step(s: Column, i: Column) -> Column:
        hit = i == token
        return F.struct(F.when(hit, s["out"]).otherwise(close(s)).alias("out"), (s["at"] + 1).alias("at"), F.when(hit, s["len"] + 1).otherwise(F.lit(0)).alias("len"))

    return F.aggregate(ids, state, step, close)


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """Centres of an n by n grid over the unit square."""
    return spark.range(n * n).select(F.col("id").cast("int").alias("i"), ((F.col("id") % n + 0.5) / n).alias("x"), ((F.floor(F.col("id") / n) + 0.5) / n).alias("y"))


def layer_grids(spark: SparkSession, n: int, layers: int, scale: int) -> DataFrame:
    """A grid for each crop layer, with n divided by scale^layer points a side."""
    out = point_grid(spark, n).withColumn("layer", F.lit(0))
    for i in range(1, layers + 1):
        out = out.unionByName(point_grid(spark, max(1, int(n / scale**i))).withColumn("layer", F.lit(i)))
    return out


def crop_boxes(images: DataFrame, width: str, height: str, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """The image itself (layer 0) and, in layer i, 2^i by 2^i overlapping crops: image_id, layer, x1, y1, x2, y2."""
    out = images.select("image_id", F.lit(0).alias("layer"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col(width).cast("int").alias("x2"), F.col(height).cast("int").alias("y2"))
    short = F.least(F.col(width), F.col(height))
    for i in range(layers):
        n = 2 ** (i + 1)
        lap = F.floor(short * overlap * 2 / n)
        size = lambda c: F.ceil((F.col(c) + lap * (n - 1)) / n)  # noqa: E731, B023
        each = images.select("image_id", F.col(width).alias("_w"), F.col(height).alias("_h"), lap.alias("_lap"), size(width).alias("_cw"), size(height).alias("_ch"), F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_k"))
        x, y = (F.floor(F.col("_k") / n) * (F.col("_cw") - F.col("_lap"))).cast("int"), ((F.col("_k") % n) * (F.col("_ch") - F.col("_lap"))).cast("int")
        out = out.unionByName(each.select("image_id", F.lit(i + 1).alias("layer"), x.alias("x1"), y.alias("y1"), F.least(x + F.col("_cw"), F.col("_w")).cast("int").alias("x2"), F.least(y + F.col("_ch"), F.col("_h")).cast("int").alias("y2")))
    return out
