"""Records, sources and objects as the test tables define them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.text import file_of, image_name, question_number, squeezed


def record_key() -> Column:
    """Key of a record: image name and question number, or the row's own id where either is missing."""
    name, number = image_name(F.col("image_id")), question_number(F.col("question_id"))
    own = F.concat(F.lit("#"), F.col("rec_id").cast("string"))
    return F.when(name.isNotNull() & number.isNotNull(), F.concat(name, F.lit("\x1f"), number)).otherwise(own)


def first_rows(rows: DataFrame, key: Column, order: str, keep: dict[str, Column]) -> DataFrame:
    """One row for each key: the values of ``keep`` in the row with the smallest ``order``, which comes along.

    Only the kept values are shuffled, after a partial aggregation, so that a
    key with very many rows does no harm.
    """
    slim = rows.select(key.alias("_k"), F.struct(F.col(order), *[c.alias(n) for n, c in keep.items()]).alias("_s"))
    return slim.groupBy("_k").agg(F.min("_s").alias("_s")).select("_k", "_s.*")


def with_source(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``source``: the registry name of a record's data set, else of its file; null if neither is known.

    The registry has one row for each source (a fixed table of nine); Spark
    decides by its measured size whether it is broadcast.
    """
    names = registry.select(squeezed(F.col("name")).alias("_name"), F.col("name").alias("_by_name")).dropDuplicates(["_name"])
    files = registry.select(file_of(F.col("file_name")).alias("_file"), F.col("name").alias("_by_file")).dropDuplicates(["_file"])
    keyed = records.withColumn("_dn", squeezed(F.col("dataset"))).withColumn("_fn", F.when(F.col("dataset").isNull(), file_of(F.col("file_name"))))
    joined = keyed.join(names, F.col("_dn") == F.col("_name"), "left").join(files, F.col("_fn") == F.col("_file"), "left")
    return joined.withColumn("source", F.coalesce("_by_name", "_by_file")).drop("_dn", "_fn", "_name", "_file", "_by_name", "_by_file")


def objects(annotations: DataFrame) -> DataFrame:
    """One row for each delivered object: ann_id, split, image, obj_id, obj_cls, referring_sentence and its key."""
    return annotations.select("ann_id", "split", image_name(F.col("image")).alias("image"), F.explode("objects").alias("o")).select(
        "ann_id", "split", "image", "o.obj_id", "o.obj_cls", "o.referring_sentence", (F.col("ann_id") * 100 + F.col("o.obj_id")).alias("key")
    )


def object_key() -> Column:
    """Key of an object over its deliveries: image name and obj_id, or the row's own key where either is missing."""
    own = F.concat(F.lit("#"), F.col("ann_id").cast("string"), F.lit("."), F.coalesce(F.col("obj_id").cast("string"), F.lit("")))
    return F.when(F.col("image").isNotNull() & F.col("obj_id").isNotNull(), F.concat("image", F.lit("\x1f"), F.col("obj_id").cast("string"))).otherwise(own)
