"""File scans: data sets in the formats of a registry, images, labels, media, caches and logs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoquarry.sources.registry import RegistryError, Source

#: File extension to format.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}
IMAGES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, so that any store is listed alike."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The file, or the files of a folder, at a path of any file system, sorted; hidden files are left out."""
    where, system = _path(spark, path)
    if not system.exists(where):
        raise RegistryError(f"file not found: {path}")
    if system.getFileStatus(where).isFile():
        return [str(system.getFileStatus(where).getPath().toString())]
    found = [s.getPath() for s in system.listStatus(where) if s.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith((".", "_")))


def format_of(files: list[str]) -> str:
    """The one format of ``files``; none, an unknown one or several raise."""
    kinds = {FORMATS.get(os.path.splitext(f)[1][1:].lower()) for f in files}
    if not files or None in kinds:
        raise RegistryError(f"file types not supported: {sorted({os.path.splitext(f)[1] for f in files})}")
    if len(kinds) > 1:
        raise RegistryError("file types should be identical")
    return kinds.pop()


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Reads a file or a folder of files of one format. JSON arrays and JSON lines are told apart by extension."""
    files = files_of(spark, path)
    kind = format_of(files)
    if kind == "arrow":
        return arrow_files(spark, path)
    reader = spark.read.schema(schema) if schema is not None and kind != "text" else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", schema is None).csv(files)
    if kind == "json":
        return reader.option("multiLine", files[0].endswith(".json")).json(files)
    if kind == "parquet":
        return reader.parquet(*files)
    return spark.read.text(files).withColumnRenamed("value", "text")


def _arrow_batches(data: bytes) -> Iterator[pa.RecordBatch]:
    """Record batches of an Arrow file or stream."""
    try:
        reader = pa.ipc.open_file(pa.BufferReader(data))
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
    except pa.ArrowInvalid:
        yield from pa.ipc.open_stream(pa.BufferReader(data))


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, each read by the task that has it; only the first file's schema is looked at to plan."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                first = next(_arrow_batches(data), None)
                if first is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([first.schema.serialize().to_pybytes()])], ["schema"])

    one = raw.mapInArrow(head, "schema binary").first()
    if one is None:
        raise RegistryError(f"no rows under {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(one["schema"])))
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for rows in _arrow_batches(data):
                    yield from pa.Table.from_batches([rows]).select(wanted.names).cast(wanted).to_batches()

    return raw.mapInArrow(run, schema)


def write_arrow(df: DataFrame, folder: str) -> None:
    """Every partition as an Arrow file, written as bytes where it is and put into the folder by the driver's file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, writer = pa.BufferOutputStream(), None
        for batch in batches:
            writer = writer or pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    spark = df.sparkSession
    where, system = _path(spark, folder)
    system.mkdirs(where)
    for i, row in enumerate(df.mapInArrow(run, "data binary").toLocalIterator()):
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{i:05d}.arrow"))
        out.write(row["data"])
        out.close()


def rename(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Gives all files of a folder with one ending another."""
    where, system = _path(spark, folder)
    for s in system.listStatus(where):
        if s.getPath().getName().endswith(old) and not s.getPath().getName().startswith((".", "_")):
            system.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(s.getPath().toString().removesuffix(old) + new))


def flatten(spark: SparkSession, folder: str, key: str) -> None:
    """Turns folders key=value of one file each into files named by the value."""
    where, system = _path(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for s in system.listStatus(where):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith(f"{key}="):
            inner = [f.getPath() for f in system.listStatus(s.getPath()) if not f.getPath().getName().startswith((".", "_"))]
            system.rename(inner[0], path(f"{folder}/{name.partition('=')[2]}"))
            system.delete(s.getPath(), True)


def cloud_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines (.jsonl) and JSON arrays (.json) of an object store or any Hadoop path; an empty listing raises instead of reading nothing."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema is not None else reader
    parts = []
    for pattern, whole in (("*.jsonl*", False), ("*.json", True)):
        probe = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
        if probe.take(1):
            parts.append(reader.option("pathGlobFilter", pattern).option("multiLine", whole).json(path))
    if not parts:
        raise RegistryError(f"no JSON files under {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def load(spark: SparkSession, source: Source, folder: str) -> DataFrame:
    """The rows of a registry entry. Hubs need a network, scripts run code of others: both raise."""
    if source.kind in ("hub", "script"):
        raise RegistryError(f"{source.name}: {source.kind} sources are not available here")
    return cloud_json(spark, source.location) if source.kind == "cloud" else scan(spark, os.path.join(folder, source.location))


def page(df: DataFrame, order: str, index: int, size: int = 2) -> DataFrame:
    """Page ``index`` of a preview, ``size`` rows each, in the order of a key."""
    return df.orderBy(order).offset(index * size).limit(size)


def save_tokenized(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def load_tokenized(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A saved data set, which makes all preparation unnecessary, or null if there is none."""
    if not path:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.parquet(path) if found else None


def image_files(spark: SparkSession, path: str, fraction: float = 1.0) -> DataFrame:
    """Image files below a folder: path, modificationTime and length, the first ``fraction`` of them by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    images = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGES))
    return images if fraction >= 1 else images.orderBy("path").limit(round(images.count() * fraction))


def label_path(image: Column) -> Column:
    """Where the label of an image lies: last folder ``images`` becomes ``labels``, the extension ``.txt``."""
    return F.concat(F.regexp_replace(F.regexp_replace(image, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ""), F.lit(".txt"))


def resolve_media(rows: DataFrame, key: str, media: str, listing: DataFrame, folder: str) -> DataFrame:
    """Puts ``folder`` before each path of the array ``media`` that exists there; others stay; an empty array becomes null.

    ``listing`` has the existing paths (path). The join is by path, so that
    neither side has to fit anywhere; arrays keep their order.
    """
    each = rows.select(key, F.posexplode(media).alias("_i", "_p")).withColumn("_full", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("_p")))
    known = listing.select(F.col("path").alias("_full"), F.lit(True).alias("_there")).distinct()
    placed = each.join(known, "_full", "left").withColumn("_r", F.when(F.col("_there"), F.col("_full")).otherwise(F.col("_p")))
    arrays = placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_r"))), lambda x: x["_r"]).alias("_m"))
    return rows.drop(media).join(arrays, key, "left").withColumnRenamed("_m", media)


def uncached(images: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Images whose key is not in the cache."""
    return images.join(cache.select(key).distinct(), key, "left_anti")


def insert_missing(entries: DataFrame, path: str, key: str = "cache_key") -> DataFrame:
    """Appends entries that a cache table lacks; running it again adds nothing. Returns what was added."""
    spark = entries.sparkSession
    present = load_tokenized(spark, path)
    new = entries.dropDuplicates([key])
    new = new if present is None else uncached(new, present, key)
    new.write.mode("append").parquet(path)
    return new


def live_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Trainer log lines with their fixed schema, as a table or a stream."""
    schema = "current_steps bigint, total_steps bigint, loss double, eval_loss double, predict_loss double, reward double, accuracy double, lr double, epoch double, percentage double, elapsed_time string, remaining_time string, throughput double, total_tokens bigint"
    return (spark.readStream if stream else spark.read).schema(schema).json(path)
