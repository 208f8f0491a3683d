"""The pN queries over the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions.text import image_name, question_number, scene
from geoquarry.llm import crosssplit, encoding, formatting, frequency, garbled, leakage, mixing, pairs, sampling, splits
from geoquarry.llm.records import first_rows, objects, record_key, with_source
from geoquarry.storage import materialize
from geoquarry.tables import table


def _records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "vqa_records").select("rec_id", "image_id", "question_id", *columns)


# 1


def _values(spark: SparkSession, d: str) -> DataFrame:
    truths = _records(spark, d, "ground_truth").select(F.lit("ground_truth").alias("field"), record_key().alias("record"), F.col("ground_truth").alias("value"))
    classes = objects(table(spark, d, "annotations")).where("image is not null").select(F.lit("obj_cls").alias("field"), F.col("image").alias("record"), F.col("obj_cls").alias("value"))
    return truths.unionByName(classes)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.value_frequencies(_values(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to five words inside the values, with their occurrences and records."""
    return frequency.word_ngrams(_values(spark, d))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of any length inside the values, a row for each run of n-grams with the same places."""
    return frequency.word_runs(_values(spark, d))


# 2


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    name = image_name(F.col("image_id"))
    return table(spark, d, "vqa_records").select(name.alias("image"), scene(name).alias("node"), question_number(F.col("question_id")).alias("link"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).where("image is not null")
    _, roots = splits.spanning_forest(splits.link_edges(rows))
    # Only scenes that have an edge can be in a group of two scenes or more.
    images = rows.select("image", "node").distinct().join(roots, "node")
    least = images.groupBy("root").agg(F.min("image").alias("group_image"))
    return images.join(least, "root").select("image", "group_image")


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, group and new split of each record; a record without image goes with its question number, else alone."""
    name, number = image_name(F.col("image_id")), question_number(F.col("question_id"))
    alone = F.concat(F.lit("#"), F.col("rec_id").cast("string"))
    node = F.coalesce(F.concat(F.lit("s"), scene(name)), F.concat(F.lit("q"), number), alone)
    records = first_rows(_records(spark, d), record_key(), "rec_id", {"node": node, "link": number}).select("rec_id", "node", "link")
    # A repeated delivery has the same scene and number, so the records hold every link.
    records = materialize(records, "records")
    groups = splits.linked_groups(records.select("node").distinct(), records.select("node", "link"))
    grouped = materialize(records.join(groups, "node").select("rec_id", "root"), "grouped")
    dealt = splits.deal_groups(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size")), table(spark, d, "split_targets"))
    return grouped.join(dealt, "root").select("rec_id", F.col("root").alias("group"), "split")


def p2_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest over scenes, an edge a row."""
    rows = _nodes(spark, d).where("image is not null")
    return splits.spanning_forest(splits.link_edges(rows))[0].select("a", "b")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    done = p2_split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("group").alias("groups"))
    shares = table(spark, d, "split_targets")
    return shares.join(done, "split", "left").fillna(0, ["records", "groups"]).withColumn("share", F.col("records") / F.expr("nullif(sum(records) over (), 0)"))


# 3


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.questions(table(spark, d, "vqa_records")).unionByName(crosssplit.sentences(table(spark, d, "annotations")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = crosssplit.near_pairs(_texts(spark, d))
    return pairs.select("kind", F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """kind, eval_key, split and source of all rows of val and test; annotations are VRSBench throughout (FIXTURES F5)."""
    split = F.lower(F.trim("split"))
    rows = table(spark, d, "vqa_records").where(split.isin("val", "test")).select("rec_id", split.alias("split"), "dataset", "file_name")
    asked = with_source(rows, table(spark, d, "dataset_registry")).select(F.lit("question").alias("kind"), F.col("rec_id").alias("eval_key"), "split", "source")
    referred = objects(table(spark, d, "annotations")).where(split.isin("val", "test")).select(F.lit("referring").alias("kind"), F.col("key").alias("eval_key"), split.alias("split"), F.lit("VRSBench").alias("source"))
    return asked.unionByName(referred)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.record_coverage(crosssplit.near_pairs(_texts(spark, d)), _evaluated(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_report(crosssplit.near_pairs(_texts(spark, d)), _evaluated(spark, d))


# 4


def _sized(spark: SparkSession, d: str) -> DataFrame:
    columns = _records(spark, d, "question", "ground_truth", "dataset", "file_name")
    return materialize(mixing.sized_records(columns, table(spark, d, "dataset_registry")), "sized")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mixture_plan(_sized(spark, d), table(spark, d, "mix_targets"))
    return spark.createDataFrame([(p["source"],) for p in plan if p["limited"]], "source string")


def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    return mixing.mixture(sized, mixing.mixture_plan(sized, table(spark, d, "mix_targets")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    plan = mixing.mixture_plan(sized, table(spark, d, "mix_targets"))
    report = mixing.mixture_report(spark, mixing.mixture(sized, plan), plan)
    return report.select("source", "records", "size", "limited", "used_records", "uses", "most_uses", "used_size", "share_reached", F.round("reachable_share", 9).alias("reachable_share"))


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    """Targets, repeat limits, exponents and budgets of the mixture."""
    plan = mixing.mixture_plan(_sized(spark, d), table(spark, d, "mix_targets"))
    schema = "source string, share double, target_share double, max_repeats int, exponent double, budget double, limited boolean"
    return spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in plan], schema).withColumn("exponent", F.round("exponent", 9))


# 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.further_copies(table(spark, d, "raw_records").select("raw_id", "payload"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapsed(table(spark, d, "raw_records"))


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    """How far each level of the refinement gets."""
    return formatting.refinement(table(spark, d, "raw_records").select("raw_id", "payload"))


# 6


def _items(spark: SparkSession, d: str) -> DataFrame:
    records = sampling.record_categories(_records(spark, d, "type", "question_type"))
    return materialize(records.unionByName(sampling.object_categories(table(spark, d, "annotations"))), "items")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("short").select("field", "category")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return sampling.draw(items, sampling.sample_plan(items, table(spark, d, "sample_targets"))).select("field", "category", "key", "rank", "priority")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return sampling.shortfalls(items, sampling.sample_plan(items, table(spark, d, "sample_targets")))


# 7


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "vqa_records").select("rec_id", "question", "answer", "ground_truth"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Defects by source and kind."""
    rows = with_source(table(spark, d, "vqa_records").select("rec_id", "dataset", "file_name"), table(spark, d, "dataset_registry"))
    return p7_found(spark, d).join(rows, "rec_id").groupBy("source", "defect").agg(F.count(F.lit(1)).alias("rows"))


# 8


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


# 9


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "passage"))


def p9_contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 0.8 of the shingles of an item's passage."""
    return leakage.contained(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "passage"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with the number of documents that give them away."""
    hit = p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "dataset", "split").join(hit, "item_id")


# 10


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from geoquarry.llm import oracle

    return oracle.oracle_sql()
