"""Ranks and running sums inside groups of any size, in a seeded random order.

A plain window over a group sorts the whole group in one task. Here the rows
of a group are spread over hash buckets; totals of the buckets give each its
offset, and only a bucket is sorted at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average at most; there are as many buckets as that takes.
BUCKET_ROWS = 50_000


def seeded_order(key: list[str], seed: int) -> Column:
    """The place of a row in the seeded order: the MD5 digest of the seed and the key, as hexadecimal text."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def bucket_digits(rows: int) -> int:
    """How many leading hexadecimal digits make buckets of ``BUCKET_ROWS`` rows."""
    digits = 0
    while rows > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def running_in_hash_order(df: DataFrame, group: list[str], key: list[str], value: Column, seed: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group, in seeded order of ``key``.

    ``key`` should identify a row; ties are broken arbitrarily but each row
    still gets its own place. Rows whose group is null form a group. The rows
    are counted first, and the buckets follow from their number.
    """
    digits = bucket_digits(df.count())
    rows = df.withColumn("_v", value.cast("long")).withColumn("_h", seeded_order(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group]
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_v").over(inside), F.lit(0))
    if not digits:
        return rows.withColumn(out, before).drop("_h", "_b", "_v")
    totals = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    joined = rows.alias("r").join(offsets.alias("o"), [F.col("r._b") == F.col("o._b"), *same]).select("r.*", "o._o")
    return joined.withColumn(out, F.col("_o") + before).drop("_h", "_b", "_v", "_o")


def rank_in_hash_order(df: DataFrame, group: list[str], key: list[str], seed: int, out: str) -> DataFrame:
    """Adds ``out``: the place of the row in its group, from 1, in a seeded random order of ``key``."""
    return running_in_hash_order(df, group, key, F.lit(1), seed, out).withColumn(out, F.col(out) + 1)
