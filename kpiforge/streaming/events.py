"""Streaming daily event counts (the streaming form of SRC-11, STR-1/STR-3).

Events land as files; a tumbling one-day window aggregates them in update
mode, and every micro-batch upserts the windows it changed into a
month-partitioned table keyed by date (the batch id orders the updates, so
the latest running total wins and a replayed batch is harmless).

``allowed_lateness`` sets a watermark (max event time seen minus the
lateness). A day's state is released once the watermark passes the day's
end; input rows older than the previous batch's watermark are dropped, so
a released day is never re-created with a partial total and replacing by
date stays correct. Without a watermark every day's running total stays in
state (one small row per day), which keeps results exact when landed files
arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_of_ms, utc_instant
from ..operators.facts import _exists, schema_with_month, upsert_table

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

DAILY_EVENTS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("events", T.LongType()),
    T.StructField("pageviews", T.LongType()),
    T.StructField("purchases", T.LongType()),
    T.StructField("purchase_value", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])


def daily_event_windows(stream: DataFrame, ts: str = "ts", kind: str = "event_type",
                        allowed_lateness: str | None = None) -> DataFrame:
    """Tumbling one-day windows over an event stream (running totals).

    Days are UTC days of the event wall clock, whatever the session time
    zone: the event time is turned into its UTC instant before windowing."""
    ts_type = stream.schema[ts].dataType.simpleString()
    t = utc_instant(F.col(ts)) if ts_type == "timestamp_ntz" else F.col(ts)
    s = stream.withColumn("_t", t)
    if allowed_lateness:
        s = s.withWatermark("_t", allowed_lateness)
    k = F.col(kind)
    agg = s.groupBy(F.window("_t", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(k == "view").alias("pageviews"),
        F.count_if(k == "purchase").alias("purchases"),
        F.sum(F.when(k == "purchase", F.col("value").cast("decimal(38,9)"))).alias("_pv"),
    )
    return agg.select(date_of_ms(F.unix_millis("w.start")).alias("date"), "events", "pageviews", "purchases",
                      F.coalesce(F.round("_pv", 2), F.lit(0)).cast("double").alias("purchase_value"))


def start_event_windows(spark: SparkSession, landing_path: str, table_path: str, checkpoint_path: str,
                        allowed_lateness: str | None = None, trigger: str = "availableNow",
                        max_files: int | None = None, schema: T.StructType = EVENTS_SCHEMA):
    """Start the windowed event stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    windows = daily_event_windows(reader.parquet(landing_path), allowed_lateness=allowed_lateness)

    def batch(df: DataFrame, epoch_id: int) -> None:
        upsert_table(df.sparkSession, table_path, df.withColumn("seq", F.lit(epoch_id).cast("bigint")),
                     ["date"], "seq", schema=DAILY_EVENTS_SCHEMA, keep_existing_on_null=False)

    writer = (windows.writeStream.outputMode("update").foreachBatch(batch)
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def read_daily_events(spark: SparkSession, table_path: str) -> DataFrame:
    cols = [f.name for f in DAILY_EVENTS_SCHEMA.fields if f.name != "seq"]
    if not _exists(spark, table_path):
        return spark.createDataFrame([], DAILY_EVENTS_SCHEMA).select(*cols)
    return spark.read.schema(schema_with_month(DAILY_EVENTS_SCHEMA)).parquet(table_path).select(*cols)
