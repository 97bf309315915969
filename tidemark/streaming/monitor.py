"""Streaming monitor over the event history (optional extension, section 7.6).

Per-day event volume, mean value and non-finite count per event type from a
file stream: event time is the ``ts`` column read as UTC, windows are emitted
in ``update`` mode and every
micro-batch is appended (with its batch id) to a Parquet table in shared
storage by ``foreachBatch``; the latest batch per window is the current
value.  The query checkpoints to shared storage, so a restarted or
re-scheduled driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def utc_instant(ts_ntz: str):
    """Wall-clock ``timestamp_ntz`` read as UTC, independent of the session
    time zone (``withWatermark`` needs a ``timestamp``)."""
    c = F.col(ts_ntz)
    secs = (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.second(c).cast("long"))
    return F.timestamp_seconds(secs)


def daily_volume(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                 watermark: str | None = None) -> DataFrame:
    """Windowed aggregate: (day, key) -> events, mean value, non-finite values.

    Without a watermark no event is dropped, however late its file comes; the
    state is one row per (day, key).  An endless stream may give one, and then
    drops events that are later than it."""
    x = F.col(value)
    s = stream.withColumn("__t", utc_instant(ts))
    if watermark:
        s = s.withWatermark("__t", watermark)
    g = s.groupBy(F.window("__t", "1 day").alias("w"), key).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("mean_value"),
        F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("n_bad"))
    day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return g.select(day.alias("day"), key, "n_events", "mean_value", "n_bad")


def run_monitor(spark: SparkSession, source: str, out_path: str, checkpoint: str,
                max_files_per_trigger: int = 1) -> DataFrame:
    """Process everything available (``availableNow``) and return the current
    value of every window (latest micro-batch wins)."""
    import os

    reader = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if not source.endswith("/") and os.path.splitext(source)[1]:
        # A single file: stream the glob of that name inside its folder.
        reader = reader.option("basePath", os.path.dirname(source))
        source = os.path.join(os.path.dirname(source), os.path.basename(source).replace(".parquet", "*.parquet"))
    stream = reader.parquet(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)

    q = (daily_volume(stream).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_windows(spark.read.parquet(out_path))


def current_windows(history: DataFrame, keys=("day", "event_type")) -> DataFrame:
    """Latest emitted value per window (``max_by`` on the batch id)."""
    vals = [c for c in history.columns if c not in (*keys, "batch_id")]
    latest = history.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("v"))
    return latest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in vals])
