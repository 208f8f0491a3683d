"""Queries: tracking, latest frames, logs, and windows over event time (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.plans.queries import query
from geoquarry.plans.views import frames
from geoquarry.storage import shared_folder
from geoquarry.streaming import streams, tracking
from geoquarry.tables import table


def through_stream(spark: SparkSession, rows: DataFrame, run, mode: str, label: str) -> DataFrame:
    """Writes rows, reads them as a stream until none is left, and gives the sink's last state as a table."""
    import uuid

    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    out = run(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    written = spark.read.schema(out.schema).parquet(f"{base}/out/*")
    if mode == "append":
        return written
    last = spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0]
    return spark.read.schema(out.schema).parquet(f"{base}/out/batch={last}")


@query()
def track_batch(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track(frames(spark, d))


@query()
def stream_track(spark: SparkSession, d: str) -> DataFrame:
    """The same tracks from a stream with keyed state."""
    return through_stream(spark, frames(spark, d), tracking.track_stream, "append", "track")


_TS = "SELECT user_id, event_id, event_type, value, ts FROM events"


@query("""SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def stream_latest_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return through_stream(spark, rows, lambda s: streams.latest_frame(s, "user_id", "ts", ["event_id", "value"]), "complete", "latest")


@query("""SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type""")
def stream_live_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    return through_stream(spark, rows, lambda s: streams.last_log(s, "event_type", "event_id", ["value"]), "complete", "log")


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = streams.tumbling(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "value")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def ext_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts")
    return through_stream(spark, rows, lambda s: streams.first_of(s, "ts", ["user_id", "event_type"], "365 days"), "append", "dedup").select("user_id", "event_type")
