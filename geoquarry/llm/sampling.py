"""Problem 6: a sample that matches target proportions, by divisor-method priorities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.text import normal_form
from geoquarry.llm.records import first_rows, object_key, objects, record_key
from geoquarry.operators.ranking import rank_in_hash_order


def record_categories(records: DataFrame) -> DataFrame:
    """field = type, key = rec_id and category of each record: normal form of type, else of question_type, else generic."""
    kind = F.coalesce(*[F.when(normal_form(F.col(c)) != "", normal_form(F.col(c))) for c in ("type", "question_type")], F.lit("generic"))
    return first_rows(records, record_key(), "rec_id", {"category": kind}).select(F.lit("type").alias("field"), F.col("rec_id").alias("key"), "category")


def object_categories(annotations: DataFrame) -> DataFrame:
    """field = obj_cls, key and category of each object: normal form of its class, or null for an object without one."""
    name = normal_form(F.col("obj_cls"))
    return first_rows(objects(annotations), object_key(), "key", {"category": F.when(name != "", name)}).select(F.lit("obj_cls").alias("field"), "key", "category")


def seats(available: dict[str, int], targets: list[tuple[str, float | None, int | None]], size: int) -> dict[str, int]:
    """How many rows each category gives to a sample of ``size``.

    The row of rank r in a category of share t has priority (r - 0.5) / t;
    floors come first, then the smallest priorities. Categories that are
    exhausted leave their seats to the next priorities of the others. Equal
    priorities go to the category that is named first.
    """
    share = {c: max(0.0, t or 0.0) for c, t, _ in targets}
    floor = {c: min(available.get(c, 0), max(0, m or 0)) for c, _, m in targets}
    taken, left = {}, size
    for c in sorted(floor):
        taken[c] = min(floor[c], max(0, left))
        left -= taken[c]
    if left <= 0:
        return taken

    def count(limit: float) -> dict[str, int]:
        return {c: max(taken[c], min(available.get(c, 0), int(limit * share[c] + 0.5) if share[c] else 0)) for c in taken}

    most = {c: max(taken[c], available.get(c, 0)) if share[c] else taken[c] for c in taken}
    if sum(most.values()) <= size:
        return most
    low, high = 0.0, max((available.get(c, 0) + 1) / share[c] for c in taken if share[c])
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(count(middle).values()) <= size else (low, middle)
    got = count(low)
    for c in sorted((c for c in got if share[c] and got[c] < available.get(c, 0)), key=lambda c: ((got[c] + 0.5) / share[c], c)):
        if sum(got.values()) >= size:
            break
        got[c] += 1
    return got


def sample_plan(items: DataFrame, targets: DataFrame, part: float = 0.25) -> list[dict]:
    """A row for each row of ``targets`` (field, category, target_share, min_count): available, wanted, seats.

    The sample of a field is to hold ``part`` of all its items (field, key,
    category), with or without category; ``wanted`` is the larger of the
    minimum and the share of that size, unrounded. Only categories that are
    targets are counted to the driver.
    """
    goals = [tuple(r) for r in targets.select("field", "category", "target_share", "min_count").dropDuplicates(["field", "category"]).collect()]
    names = sorted({c for _, c, _, _ in goals if c is not None})
    known = F.when(F.col("category").isin(names), F.col("category"))
    counts = {(r["field"], r["_c"]): r["n"] for r in items.groupBy("field", known.alias("_c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = []
    for field in sorted({g[0] for g in goals}):
        size = part * sum(n for (f, _), n in counts.items() if f == field)
        own = sorted((c, t, m) for f, c, t, m in goals if f == field)
        available = {c: counts.get((field, c), 0) for c, _, _ in own}
        got = seats(available, own, int(size))
        for c, t, m in own:
            wanted = max(float(m or 0), (t or 0.0) * size)
            plan.append({"field": field, "category": c, "target_share": t, "min_count": m, "available": available[c], "wanted": wanted, "seats": got[c], "sample_size": int(size)})
    return plan


def _of(plan: list[dict], name: str, kind: str):
    """A column with the entry ``name`` of the plan for the row's field and category, null where it has none."""
    pairs = [x for p in plan if p["category"] is not None for x in (F.lit(f"{p['field']}\x1f{p['category']}"), F.lit(p[name]).cast(kind))]
    return F.create_map(*pairs)[F.concat("field", F.lit("\x1f"), "category")] if pairs else F.lit(None).cast(kind)


def ranked(items: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """The items of the plan's categories, up to their seats and to what is wanted, with rank and priority.

    Ranks are by seeded order inside a category. A rank inside the floor has
    priority 0, any other (rank - 0.5) / share.
    """
    most = _of([{**p, "_most": max(p["seats"], math.ceil(p["wanted"]))} for p in plan], "_most", "long")
    known = items.where(most.isNotNull())
    rows = rank_in_hash_order(known, ["field", "category"], ["key"], seed, "rank").where(F.col("rank") <= most)
    return rows.withColumn("priority", F.when(F.col("rank") <= _of(plan, "min_count", "long"), 0.0).otherwise((F.col("rank") - 0.5) / F.nullif(_of(plan, "target_share", "double"), F.lit(0.0))))


def draw(items: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """The items in the sample, those whose rank has a seat, with their rank in the category and their priority."""
    return ranked(items, plan, seed).where(F.col("rank") <= _of(plan, "seats", "long"))


def shortfalls(items: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """The plan, with what was drawn for it: the seats taken, and whether the ranks end before the number wanted.

    Both are counted from the ranked rows themselves. ``short`` is so for a
    category whose rows, floors and seats of others aside, run out before
    the wanted number is reached.
    """
    schema = "field string, category string, target_share double, min_count int, available bigint, wanted double, seats bigint, sample_size bigint"
    planned = items.sparkSession.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in plan], schema)
    rows = ranked(items, plan, seed)
    got = rows.groupBy(F.col("field").alias("_f"), F.col("category").alias("_c")).agg(F.max("rank").alias("_last"), F.count_if(F.col("rank") <= _of(plan, "seats", "long")).alias("drawn"))
    joined = planned.join(got, (F.col("field") == F.col("_f")) & (F.col("category") == F.col("_c")), "left")
    last = F.coalesce("_last", F.lit(0))
    return joined.select(*planned.columns, F.coalesce("drawn", F.lit(0)).alias("drawn"), (last < F.col("wanted")).alias("short"))
