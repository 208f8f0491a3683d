"""Written intermediate tables in the folder all executors share.

A written table cuts lineage as ``checkpoint()`` does, but is columnar and
compressed, and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used in local mode only; on a
    cluster this raises, because no machine-local folder is shared there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_geoquarry_shared", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="geoquarry-")
        context._geoquarry_shared = folder
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written(spark).append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    """The tables that this session wrote and has not released."""
    context = spark.sparkContext
    if not hasattr(context, "_geoquarry_written"):
        context._geoquarry_written = []
    return context._geoquarry_written


def release(spark: SparkSession) -> int:
    """Deletes all intermediate tables written so far, to be called when the results that rest on them are used; says how many there were.

    They also go when the session's JVM ends.
    """
    paths = _written(spark)
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    count = len(paths)
    paths.clear()
    return count
