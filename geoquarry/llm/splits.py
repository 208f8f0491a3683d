"""Problem 2: splits that keep related records together, over a spanning forest built by edge contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators.ranking import running_in_hash_order
from geoquarry.storage import materialize


def link_edges(pairs: DataFrame) -> DataFrame:
    """Edges (a, b, w) between nodes that share a link, from ``pairs`` (node, link).

    The nodes of a link are tied to its smallest node, so that a link of k
    nodes gives k - 1 edges, however large it is. A link of one node ties
    nothing and is dropped before any join. Weights are hashes; together
    with the ends they put all edges into one strict order.
    """
    seen = pairs.where("node is not null and link is not null").distinct()
    least = seen.groupBy("link").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a <> _z").drop("_z")
    edges = seen.join(least, "link").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return edges.withColumn("w", F.xxhash64(F.lit(7), "a", "b"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of ``edges`` (a, b, w) and the root of every node in it.

    Rounds of contraction: every component takes its smallest outgoing edge;
    the picks form trees with one mutual pair each, whose smaller end becomes
    the root; pointers are doubled until all point at roots; edges inside a
    component are dropped. A component at least doubles in each round, so
    there are at most log2(nodes) rounds. All that a round leaves is written
    to the shared folder, the forest included, and nothing but counts comes
    to the driver. Returns (forest: a, b, w), (nodes: node, root), the latter
    with a row for each end of an edge.
    """
    spark = edges.sparkSession
    live = materialize(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    roots = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    forest: DataFrame | None = None
    while live.take(1):
        both = live.select(F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("other")).unionByName(live.select(F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("other")))
        picks = materialize(both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "other")).alias("p")).select("c", "p.*"), "picks")
        forest = picks.select("a", "b", "w") if forest is None else forest.unionByName(picks.select("a", "b", "w"))
        back = picks.select(F.col("c").alias("other"), F.col("other").alias("_up"))
        parent = F.when((F.col("_up") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other"))
        point = materialize(picks.join(back, "other", "left").select("c", parent.alias("up")), "points")
        while True:
            up = point.select(F.col("c").alias("up"), F.col("up").alias("_next"))
            jumped = materialize(point.join(up, "up").select("c", F.col("_next").alias("up"), (F.col("_next") != F.col("up")).alias("moved")), "points")
            point = jumped.select("c", "up")
            if not jumped.where("moved").take(1):
                break
        ends = lambda side: point.select(F.col("c").alias(side), F.col("up").alias(f"_{side}"))
        merged = live.join(ends("ca"), "ca").join(ends("cb"), "cb").where("_ca <> _cb")
        live = materialize(merged.select("a", "b", "w", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")), "edges")
        roots = materialize(roots.join(point.withColumnRenamed("c", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
    if forest is None:
        forest = spark.createDataFrame([], edges.select("a", "b", "w").schema)
    return forest.distinct(), roots


def linked_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` (node) with ``root``, the smallest node of the node's group; a node without links is its own root."""
    _, roots = spanning_forest(link_edges(pairs))
    least = roots.groupBy("root").agg(F.min("node").alias("_least"))
    named = roots.join(least, "root").select("node", F.col("_least").alias("root"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def deal_groups(groups: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Gives each group (root, size) a split in the shares of ``targets`` (split, target_share).

    Groups are stratified by the power of two of their size. Inside a band
    they stand in seeded order on a line of their sizes, which is dealt out
    systematically: the line is cut into cycles, a cycle into spans in the
    splits' shares, and a group falls to the split whose span holds its
    middle. A cycle holds about 1,024 groups, or the whole band where it has
    fewer. The band with the most groups is
    dealt last, in shares that make up for the rounding of all others; for
    that, sums by band and split come to the driver, at most 64 rows a split.
    Shares that don't add up to 1 are scaled; null shares count 0. Returns
    root, size, band and split; without a positive share, split is null.
    """
    share = [(r["split"], max(0.0, r["target_share"] or 0.0)) for r in targets.select("split", "target_share").collect()]
    whole = sum(s for _, s in share)
    band = F.length(F.bin(F.greatest(F.col("size"), F.lit(1)).cast("bigint"))) - 1
    banded = groups.select("root", "size", band.alias("band"))
    if not whole:
        return banded.withColumn("split", F.lit(None).cast("string"))
    share = sorted(((n, s / whole) for n, s in share if s), key=lambda x: (-x[1], x[0] or ""))
    placed = materialize(running_in_hash_order(banded, ["band"], ["root"], F.col("size"), seed, "before"), "line")
    bands = placed.groupBy("band").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("groups")).collect()

    def split_of(b, parts: list[tuple[str, float]]):
        cycle = b["total"] / max(1, b["groups"] // 1024)
        at, low, chosen = ((F.col("before") + F.col("size") / 2) % cycle) / cycle, 0.0, None
        for name, part in parts[:-1]:
            low += part
            chosen = F.when(at < low, name) if chosen is None else chosen.when(at < low, name)
        return F.lit(parts[-1][0]) if chosen is None else chosen.otherwise(parts[-1][0])

    def dealt(parts_of) -> DataFrame:
        split = F.lit(share[0][0])
        for b in bands:
            split = F.when(F.col("band") == b["band"], split_of(b, parts_of(b))).otherwise(split)
        return placed.withColumn("split", split).drop("before")

    if not bands:
        return dealt(lambda b: share)
    last = max(bands, key=lambda b: (b["groups"], -b["band"]))
    have = {r["split"]: r["n"] for r in dealt(lambda b: share).where(F.col("band") != last["band"]).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(b["total"] for b in bands)
    want = [(n, max(0.0, s * total - have.get(n, 0))) for n, s in share]
    room = sum(w for _, w in want)
    made_up = [(n, w / room) for n, w in want] if room else share
    return dealt(lambda b: made_up if b["band"] == last["band"] else share)
