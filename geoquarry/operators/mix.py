"""Concatenating, interleaving, sampling, splitting and sharding of tables by seeded keys.

All randomness is a hash of seed and key, so results depend neither on
partitioning nor on file order. Order is by explicit keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.operators.ranking import rank_in_hash_order
from geoquarry.storage import materialize


def draw(seed: int, *key: str | Column) -> Column:
    """A uniform number of [0, 1) for a key: the first 13 hex digits of an md5 that any engine can compute."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(16**13)


def concat(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, with ``dataset_idx``, the place of their part."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("dataset_idx", F.lit(i)) for i, p in enumerate(parts)])


def numbered(df: DataFrame, key: str, out: str = "row_no") -> DataFrame:
    """Numbers rows from 0 in the order of ``key`` without sorting the table in one task.

    Rows are sorted by range and numbered inside their range; the sizes of
    the ranges, a row for each, give the offsets. The ranges are written
    before they are counted, because a second evaluation would draw other
    borders. ``key`` must be unique.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    inside = Window.partitionBy("_part").orderBy(key)
    ranged = df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    placed = materialize(ranged.withColumn("_in", F.row_number().over(inside) - 1), "ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return placed.join(offsets, "_part").withColumn(out, F.col("_in") + F.col("_o")).drop("_part", "_o", "_in")


def interleave(parts: list[DataFrame], key: str, strategy: str = "under") -> DataFrame:
    """Takes turns between the parts, in each by ``key``: ``turn`` and ``dataset_idx`` give the order.

    ``under`` stops when the first part ends, ``over`` starts ended parts
    again until the longest has ended once.
    """
    rows = [numbered(p, key, "_k").withColumn("dataset_idx", F.lit(i)) for i, p in enumerate(parts)]
    sizes = [p.count() for p in parts]
    if strategy not in ("under", "over"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "under":
        return reduce(DataFrame.unionByName, [r.where(F.col("_k") < min(sizes)).withColumnRenamed("_k", "turn") for r in rows])
    turns = [r.withColumn("turn", F.explode(F.sequence(F.col("_k"), F.lit(max(sizes) - 1), F.lit(n)))) if n else r.withColumn("turn", F.col("_k")) for r, n in zip(rows, sizes)]
    return reduce(DataFrame.unionByName, [t.where(F.col("_k") < max(sizes)).drop("_k") for t in turns])


def interleave_by_chance(parts: list[DataFrame], key: str, weights: list[float], seed: int) -> DataFrame:
    """Draws the part of each turn with given weights until one part ends; a turn takes the part's next row by ``key``.

    The draws need as many turns as the result has rows; they are made as a
    table, and running counts by part join them to the rows.
    """
    spark = parts[0].sparkSession
    rows = reduce(DataFrame.unionByName, [numbered(p, key, "_k").withColumn("dataset_idx", F.lit(i)) for i, p in enumerate(parts)])
    sizes, total = [p.count() for p in parts], sum(weights)
    most = int(min(n * total / w for n, w in zip(sizes, weights) if w > 0) * 1.2) + 64
    u, low, choice = draw(seed, "id"), 0.0, F.lit(len(parts) - 1)
    bounds = []
    for w in weights[:-1]:
        low += w / total
        bounds.append(low)
    for i in reversed(range(len(bounds))):
        choice = F.when(u < bounds[i], i).otherwise(choice)
    turns = spark.range(most).select(F.col("id").alias("turn"), choice.alias("dataset_idx"))
    block = F.floor(F.col("turn") / 4096)
    counts = turns.groupBy("dataset_idx", block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy("dataset_idx").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = turns.withColumn("_b", block).join(offsets, ["dataset_idx", "_b"]).withColumn("_k", F.row_number().over(Window.partitionBy("dataset_idx", "_b").orderBy("turn")) - 1 + F.col("_o"))
    ended = placed.join(spark.createDataFrame(list(enumerate(sizes)), "dataset_idx int, _size bigint"), "dataset_idx").where(F.col("_k") >= F.col("_size")).agg(F.min("turn")).first()[0]
    kept = placed.where(F.col("turn") < ended) if ended is not None else placed
    return kept.select("turn", "dataset_idx", "_k").join(rows, ["dataset_idx", "_k"]).drop("_k")


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows: a seeded draw without replacement, and, beyond the table's size, further draws with replacement. ``copy`` counts a row's uses from 0."""
    spark = df.sparkSession
    size = df.count()
    if not size:
        return df.withColumn("copy", F.lit(0))
    # Rows below the n-th draw: a threshold by a bucketed count, so that only one bucket is sorted.
    ranked = df.withColumn("_u", draw(seed, key))
    if n <= size:
        w = Window.orderBy("_u", key)
        edge = ranked.select(F.floor(F.col("_u") * 1024).alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.sum("_n").over(Window.orderBy("_b"))).where(F.col("_c") >= n).orderBy("_b").first()
        if edge is None:
            return ranked.drop("_u").withColumn("copy", F.lit(0))
        bucket = F.floor(F.col("_u") * 1024)
        inside = ranked.where(bucket == edge["_b"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n - (edge["_c"] - edge["_n"])).drop("_r")
        return ranked.where(bucket < edge["_b"]).unionByName(inside).drop("_u").withColumn("copy", F.lit(0))
    rows = numbered(df, key, "_k")
    extra = spark.range(n - size).select(F.floor(draw(seed + 1, "id") * size).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_more"))
    times = rows.join(extra, "_k", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)).cast("int"))))
    return times.drop("_k", "_more")


def split(df: DataFrame, key: str, part: float, seed: int) -> DataFrame:
    """Adds ``split``: about ``part`` of the rows, by hash of their key, are ``validation``; works on streams as on tables."""
    return df.withColumn("split", F.when(draw(seed, key) < part, "validation").otherwise("train"))


def split_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Adds ``split``: exactly ``n`` rows (all, if there are fewer) are ``validation``."""
    chosen = sample_exact(df.select(key), key, min(n, df.count()), seed).select(key, F.lit("validation").alias("_s"))
    return df.join(chosen, key, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def modules(df: DataFrame) -> dict[str, DataFrame]:
    """A table with ``split`` as a table for each of its splits."""
    names = [r["split"] for r in df.select("split").distinct().orderBy("split").collect()]
    return {n: df.where(F.col("split") == n).drop("split") for n in names}


def autosplit(files: DataFrame, path: str, weights: tuple[float, float, float] = (0.9, 0.1, 0.0), seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """train, val or test for each path by weights; only paths with a label if ``labels`` (the same column) is given."""
    rows = files if labels is None else files.join(labels.select(path), path, "left_semi")
    a, b = weights[0] / sum(weights), (weights[0] + weights[1]) / sum(weights)
    u = draw(seed, path)
    return rows.withColumn("split", F.when(u < a, "train").when(u < b, "val").otherwise("test"))


def shard(df: DataFrame, key: str, world: int) -> DataFrame:
    """Adds ``rank``: rows in the order of ``key`` go round the ranks."""
    return numbered(df, key).withColumn("rank", (F.col("row_no") % world).cast("int"))


def shard_contiguous(df: DataFrame, key: str, world: int) -> DataFrame:
    """Adds ``rank``: slices of equal length of the distinct rows in the order of ``key``."""
    rows = numbered(df.dropDuplicates([key]), key)
    size = rows.count()
    step = max(1, -(-size // world))
    return rows.withColumn("rank", F.floor(F.col("row_no") / step).cast("int"))


def select_rows(df: DataFrame, key: str, index: int | slice | list[int]) -> DataFrame:
    """Rows by place in the order of ``key``: one, a slice or a list, which may repeat places."""
    rows = numbered(df, key)
    if isinstance(index, int):
        return rows.where(F.col("row_no") == index)
    if isinstance(index, slice):
        n = df.count() if index.stop is None or index.stop < 0 or (index.start or 0) < 0 else None
        start, stop, step = index.indices(n if n is not None else index.stop)
        return rows.where((F.col("row_no") >= start) & (F.col("row_no") < stop) & ((F.col("row_no") - start) % step == 0))
    wanted = df.sparkSession.createDataFrame([(i,) for i in index], "row_no bigint")
    return rows.join(wanted, "row_no")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once an epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def support(targets: DataFrame, pool: DataFrame, group: str, target: str, item: str, k: int, seed: int) -> DataFrame:
    """``k`` items out of the whole pool of the target's group for each target, with their rank.

    Each group's items stand in a seeded order and are numbered over buckets.
    A target draws ``k`` distinct places out of all places of its group: the
    i-th draw is uniform over all but the last ``k - i`` places, and takes
    the last place open to it if the drawn one is taken. Only the drawn
    places are joined. A group with fewer items gives them all; a target
    whose group has none gets no row.
    """
    placed = rank_in_hash_order(pool, [group], [item], seed, "_place").withColumn("_place", F.col("_place") - 1)
    sizes = pool.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    draws = F.array(*[draw(seed + 1 + i, target) for i in range(k)])
    start = F.col("_size") - F.least(F.lit(k), F.col("_size"))

    def take(taken: Column, i: Column) -> Column:
        drawn = F.floor(F.element_at(draws, i + 1) * (start + i + 1))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), start + i).otherwise(drawn)))

    places = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_size")).cast("int") - 1), F.array().cast("array<bigint>"), take)
    chosen = targets.join(sizes, group).select("*", F.posexplode(places).alias("_rank", "_place")).withColumn("rank", F.col("_rank") + 1)
    return chosen.join(placed, [group, "_place"]).drop("_place", "_rank", "_size")


def stacked(df: DataFrame, chosen: list[str], rejected: list[str], names: list[str], keys: list[str]) -> DataFrame:
    """Pairs as rows: all chosen sides, then all rejected, by the column ``side``."""
    one = lambda cols, side: df.select(*keys, F.lit(side).alias("side"), *[F.col(c).alias(n) for c, n in zip(cols, names)])
    return one(chosen, "chosen").unionByName(one(rejected, "rejected"))


def multi_label(df: DataFrame, scores: str, least: float, all_labels: bool) -> DataFrame:
    """One row for each class above ``least``, or the best class if it is; adds ``cls`` and ``conf``."""
    if all_labels:
        return df.select("*", F.posexplode(scores).alias("cls", "conf")).where(F.col("conf") > least)
    top = F.array_max(scores)
    return df.withColumn("cls", (F.array_position(scores, top) - 1).cast("int")).withColumn("conf", top).where(F.col("conf") > least)


def hash_bucket(df: DataFrame, key: list[str], seed: int, buckets: int = 1024) -> DataFrame:
    """Adds ``bucket``, one of ``buckets`` by hash of a key."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(buckets)).cast("int"))
