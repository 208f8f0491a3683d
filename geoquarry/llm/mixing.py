"""Problem 4: mixing sources to target weights by temperature, with capped repeats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.records import first_rows, record_key, with_source
from geoquarry.operators.ranking import running_in_hash_order

ROUNDS = 200


def sized_records(records: DataFrame, registry: DataFrame) -> DataFrame:
    """rec_id, source and size of each record once, taken from its row with the smallest rec_id.

    The size is the number of characters of question and ground truth; null
    counts 0. A record whose source is not registered is left out.
    """
    size = (F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("ground_truth", F.lit("")))).cast("long")
    first = first_rows(records, record_key(), "rec_id", {"dataset": F.col("dataset"), "file_name": F.col("file_name"), "size": size})
    return with_source(first, registry).where("source is not null").select("rec_id", "source", "size")


def common_exponent(sources: list[dict]) -> tuple[float, list[dict]]:
    """The largest exponent in [0, 1] at which all sources keep their repeat limit, and the sources that stop it there.

    A source's weight is its share of all sizes times the ratio of target to
    share, raised to the exponent: 0 leaves the natural shares, 1 gives the
    targets. At 1 the limit is tested on exact sizes; below, the exponent is
    bisected. No source stops an exponent of 1.
    """

    def over(a: float) -> list[dict]:
        if a == 1.0:
            return [s for s in sources if s["size"] * s["max_repeats"] < s["target_share"] * s["total"]]
        return [s for s in sources if (s["target_share"] / s["share"]) ** a > s["max_repeats"]]

    if not over(1.0):
        return 1.0, []
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return low, over(high)


def entropy_exponent(shares: list[float], bits: float) -> float:
    """The common exponent for which normalised powers of ``shares`` have an entropy of ``bits``, found by bisection.

    0 gives equal weights and the greatest entropy, large values the smallest;
    a goal beyond these gives the nearer end.
    """
    positive = [s for s in shares if s > 0]

    def entropy(a: float) -> float:
        top = max(positive)
        powers = [(s / top) ** a for s in positive]
        total = sum(powers)
        return -sum(p / total * math.log2(p / total) for p in powers if p)

    if not positive or entropy(0.0) <= bits:
        return 0.0
    low, high = 0.0, 64.0
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) > bits else (low, middle)
    return high


def plan_mixture(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float | None, int | None]]) -> list[dict]:
    """For each target (source, target_share, max_repeats), what the mixture takes from its source.

    ``sizes`` has records and size by source; the mixture is as large as all
    sources of the targets together. One exponent for all sources is bisected
    until the tightest repeat limit stops it (``common_exponent``). The
    sources that stop it are ``limited``: they stay at their limit, and the
    exponent of the others is bisected on, until it reaches the targets. The
    weights of the others are then normalised to what the limited sources
    leave, under their own limits, so ``reachable_share`` adds up to 1 unless
    all limits together are too small. A target share that is null is set by
    the exponent at which the open sources' powers have the entropy of equal
    parts less one bit; a null repeat limit is 1. A source without records or
    repeats can give nothing and is limited if it has a target.
    """
    total = sum(sizes.get(s, (0, 0))[1] for s, _, _ in targets)
    open_sources = [s for s, t, _ in targets if t is None]
    rest = max(0.0, 1.0 - sum(t for _, t, _ in targets if t is not None))
    shares = [sizes.get(s, (0, 0))[1] / total if total else 0.0 for s in open_sources]
    common = entropy_exponent(shares, max(0.0, math.log2(len(shares)) - 1)) if shares else 1.0
    powers = [x**common if x else 0.0 for x in shares]
    filled = {s: rest * p / sum(powers) if sum(powers) else 0.0 for s, p in zip(open_sources, powers)}
    plan = []
    for source, target, repeats in targets:
        records, size = sizes.get(source, (0, 0))
        repeats = 1 if repeats is None else max(0, repeats)
        target = filled[source] if target is None else max(0.0, target)
        plan.append({"source": source, "records": records, "size": size, "share": size / total if total else 0.0, "target_share": target, "max_repeats": repeats, "total": total, "exponent": 0.0, "limited": False})
    free = []
    for p in plan:
        if p["size"] and p["max_repeats"]:
            free.append(p)
        else:
            p["limited"] = p["target_share"] * total > 0
    while free:
        exponent, tight = common_exponent(free)
        for p in tight or free:
            p["exponent"], p["limited"] = exponent, bool(tight)
        free = [p for p in free if not p["limited"]] if tight else []
    # Weights of the free sources, normalised to what the limited ones leave.
    limit = {p["source"]: p["size"] * p["max_repeats"] for p in plan}
    at = lambda scale: {p["source"]: limit[p["source"]] if p["limited"] else min(limit[p["source"]], p["target_share"] * total * scale) for p in plan}
    goal = min(float(total), sum(limit[p["source"]] for p in plan if p["limited"] or p["target_share"]))
    low, high = 0.0, 1.0
    while sum(at(high).values()) < goal and high < 1e12:
        high *= 2
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) < goal else (low, middle)
    budgets = at(high)
    used = sum(budgets.values())
    for p in plan:
        p["budget"] = float(budgets[p["source"]] if p["limited"] else min(limit[p["source"]], round(budgets[p["source"]], 6)))
        p["reachable_share"] = budgets[p["source"]] / used if used else 0.0
    return plan


def mixture_plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """``plan_mixture`` over the sizes of ``sized``; one row for each source comes to the driver."""
    wanted = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    counted = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).join(wanted.select("source"), "source", "left_semi")
    sizes = {r["source"]: (r["n"], r["size"]) for r in counted.collect()}
    return plan_mixture(sizes, sorted(((r["source"], r["target_share"], r["max_repeats"]) for r in wanted.collect()), key=lambda x: x[0] or ""))


def mixture(sized: DataFrame, plan: list[dict], seed: int = 13) -> DataFrame:
    """rec_id, source, size and ``copies`` of each record in the mixture.

    A source's budget is spent in blocks, each a permutation of the source:
    as many whole blocks as fit, and the beginning of one more, which ends
    before the first record that would exceed the budget. The last block is
    laid out by running sums over hash buckets, never by sorting a source in
    one task.
    """
    whole = {p["source"]: int(p["budget"] // p["size"]) if p["size"] else 0 for p in plan}
    rest = {p["source"]: p["budget"] - whole[p["source"]] * p["size"] for p in plan}
    if not plan:
        return sized.withColumn("copies", F.lit(0)).where("false")
    by = lambda d, kind: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast(kind))])[F.col("source")]
    known = sized.where(F.col("source").isin(list(whole)))
    placed = running_in_hash_order(known, ["source"], ["rec_id"], F.col("size"), seed, "before")
    extra = (F.col("before") + F.col("size") <= by(rest, "double")).cast("int") * (by(rest, "double") > 0).cast("int")
    return placed.withColumn("copies", by(whole, "int") + extra).where("copies > 0").drop("before")


def mixture_report(spark, mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """The plan with what was used: records, uses, the most uses of a record, the size and the share reached."""
    schema = "source string, records bigint, size bigint, share double, target_share double, max_repeats int, exponent double, budget double, reachable_share double, limited boolean"
    planned = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in plan], schema)
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used_records"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("copies") * F.col("size")).alias("used_size"))
    joined = planned.join(used, "source", "left").fillna(0, ["used_records", "uses", "most_uses", "used_size"])
    return joined.withColumn("share_reached", F.col("used_size") / F.expr("nullif(sum(used_size) over (), 0)"))
