"""Sessions and daily activity from an event stream with late and repeated rows (SRC-10, SRC-11, STR-1, STR-3).

Two queries read the landed event files:

* ``start_sessions``: each event once (``dropDuplicatesWithinWatermark`` on the
  event id), then ``session_window`` per user in append mode. A late event
  within the watermark can merge two open sessions; a session is written once,
  when the watermark has passed its end.
* ``start_activity``: each event once, then the micro-batch's counts per user
  and day, stored as partial sums.

Both sinks write the micro-batch as the partition ``epoch=<batch id>`` and
replace that partition only, so a replayed batch changes nothing.

``read_sessions`` adds the sessions that are still open: they are read from the
state store of the last committed batch, so a report needs no closing event,
and only epochs up to that batch are read, so a session is never counted twice
while the query runs. ``read_daily_metrics`` is the report of
``sources.events.daily_metrics`` over both tables.

Rows later than ``allowed_lateness`` are dropped by the watermark; an event id
that comes again after more than that counts again. Events without an id are
known by all their columns. Events without a user are counted by the activity
and are in no session. A user whose events never pause for the gap keeps one
state row, whatever their number; events of one user in one task's input are
merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import date_of_ms, utc_instant
from ..operators.facts import _exists
from ..sources.events import rates
from .events import EVENTS_SCHEMA

#: Sessions are merged inside each input partition before rows are shuffled.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def unique_events(stream: DataFrame, event_id: str = "event_id", ts: str = "ts", allowed_lateness: str = "2 days") -> DataFrame:
    """Each event once: repeated ids within the lateness go. The watermark is on ``_t``, the event time as an instant."""
    t = F.col(ts)
    kind = stream.schema[ts].dataType.simpleString()
    whole = F.when(F.col(event_id).isNull(), F.xxhash64(*[F.col(c) for c in stream.columns]))
    s = stream.withColumns({"_t": utc_instant(t) if kind == "timestamp_ntz" else t, "_whole": whole})
    return s.withWatermark("_t", allowed_lateness).dropDuplicatesWithinWatermark([event_id, "_whole"]).drop("_whole")


def session_windows(events: DataFrame, user: str = "user_id", gap_minutes: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by, user, start, last, events) of each session: events with pauses of at most the gap."""
    if gap_minutes < 1:
        raise ValueError("gap_minutes must be at least 1")
    gap = f"{int(gap_minutes)} minutes"
    # the state store keeps the names of grouping columns, and ``open_sessions`` reads them there
    known = events.where(F.col(user).isNotNull()).withColumn("user", F.col(user))
    s = known.groupBy(*by, "user", F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select(*by, "user", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("last"), "events")


def _epoch_sink(table_path: str, reduce):
    """A foreachBatch function that replaces the batch's own partition."""
    def batch(df: DataFrame, epoch: int) -> None:
        out = reduce(df).withColumn("epoch", F.lit(epoch).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(table_path)
    return batch


def _started(stream: DataFrame, table_path: str, checkpoint_path: str, trigger: str, reduce) -> StreamingQuery:
    writer = (stream.writeStream.outputMode("append").foreachBatch(_epoch_sink(table_path, reduce))
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def _landed(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def start_sessions(spark: SparkSession, landing_path: str, table_path: str, checkpoint_path: str,
                   allowed_lateness: str = "2 days", gap_minutes: int = 30, by: Sequence[str] = (),
                   trigger: str = "availableNow", max_files: int | None = None, schema: T.StructType = EVENTS_SCHEMA,
                   event_id: str = "event_id", user: str = "user_id", ts: str = "ts") -> StreamingQuery:
    """Start the session stream; closed sessions are appended to ``table_path``."""
    spark.conf.set(LOCAL_MERGE, "true")
    events = unique_events(_landed(spark, landing_path, schema, max_files), event_id, ts, allowed_lateness)
    return _started(session_windows(events, user, gap_minutes, by), table_path, checkpoint_path, trigger, lambda df: df)


def start_activity(spark: SparkSession, landing_path: str, table_path: str, checkpoint_path: str,
                   allowed_lateness: str = "2 days", by: Sequence[str] = (), trigger: str = "availableNow",
                   max_files: int | None = None, schema: T.StructType = EVENTS_SCHEMA, event_id: str = "event_id",
                   user: str = "user_id", ts: str = "ts", kind: str = "event_type", pageview: str = "view",
                   purchase: str = "purchase", value: str = "value") -> StreamingQuery:
    """Start the activity stream: partial sums per (by, user, day) of every micro-batch."""
    events = unique_events(_landed(spark, landing_path, schema, max_files), event_id, ts, allowed_lateness)
    k = F.col(kind)

    def reduce(df: DataFrame) -> DataFrame:
        return df.groupBy(*by, F.col(user).alias("user"), F.col(ts).cast("date").alias("date")).agg(
            F.count(F.lit(1)).alias("events"), F.count_if(k == pageview).alias("pageviews"),
            F.count_if(k == purchase).alias("purchases"),
            F.sum(F.when(k == purchase, F.col(value).cast("decimal(38,9)"))).alias("purchase_value"))

    return _started(events, table_path, checkpoint_path, trigger, reduce)


def committed_batch(spark: SparkSession, checkpoint_path: str) -> int | None:
    """The last batch whose state is committed."""
    meta = spark.read.format("state-metadata").load(checkpoint_path)
    return meta.agg(F.max("maxBatchId").alias("b")).first()["b"]


def open_sessions(spark: SparkSession, checkpoint_path: str, batch: int, gap_minutes: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Sessions that the state store holds after ``batch``."""
    operator = spark.read.format("state-metadata").load(checkpoint_path).where(
        F.col("operatorName").startswith("sessionWindow")).select("operatorId").first()["operatorId"]
    state = spark.read.format("statestore").option("operatorId", operator).option("batchId", batch).load(checkpoint_path)
    v = F.col("value")
    return state.select(*[v[b].alias(b) for b in by], v["user"].alias("user"), v["session_window"]["start"].alias("start"),
                        (v["session_window"]["end"] - F.expr(f"INTERVAL {int(gap_minutes)} minutes")).alias("last"),
                        v["count"].alias("events"))


def read_sessions(spark: SparkSession, table_path: str, checkpoint_path: str, gap_minutes: int = 30,
                  by: Sequence[str] = ()) -> DataFrame:
    """All sessions as of the last committed batch: closed ones and those still open (column ``closed``)."""
    batch = committed_batch(spark, checkpoint_path)
    opened = open_sessions(spark, checkpoint_path, batch, gap_minutes, by).withColumn("closed", F.lit(False))
    if not _exists(spark, table_path):
        return opened
    kind = T.StructType([f for f in opened.schema.fields if f.name != "closed"] + [T.StructField("epoch", T.LongType())])
    closed = spark.read.schema(kind).parquet(table_path).where(F.col("epoch") <= batch).drop("epoch")
    return closed.withColumn("closed", F.lit(True)).unionByName(opened)


def read_activity(spark: SparkSession, table_path: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, user, date, events, pageviews, purchases, purchase_value): partial sums of all epochs added up."""
    a = spark.read.parquet(table_path)
    sums = ["events", "pageviews", "purchases"]
    return a.groupBy(*by, "user", "date").agg(*[F.sum(c).alias(c) for c in sums], F.sum("purchase_value").alias("purchase_value"))


def read_daily_events(spark: SparkSession, table_path: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, events, pageviews, purchases, purchase_value) over all epochs."""
    a = spark.read.parquet(table_path).groupBy(*by, "date").agg(
        F.sum("events").alias("events"), F.sum("pageviews").alias("pageviews"), F.sum("purchases").alias("purchases"),
        F.sum("purchase_value").alias("_v"))
    return a.select(*by, "date", "events", "pageviews", "purchases",
                    F.coalesce(F.round("_v", 2), F.lit(0)).cast("double").alias("purchase_value"))


def read_daily_metrics(spark: SparkSession, sessions_path: str, sessions_checkpoint: str, activity_path: str,
                       gap_minutes: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """The report of ``sources.events.daily_metrics``: sessions count on the UTC day of their start."""
    by = list(by)
    s = read_sessions(spark, sessions_path, sessions_checkpoint, gap_minutes, by)
    day = date_of_ms(F.unix_millis("start"))
    zero = F.lit(0).cast("long")
    starts = s.groupBy(*by, day.alias("date")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("events") == 1).alias("bounces"))
    per_user = read_activity(spark, activity_path, by)
    days = per_user.groupBy(*by, "date").agg(F.count("user").alias("visitors"), F.sum("pageviews").alias("pageviews"), F.sum("events").alias("events"))
    both = days.select(*by, "date", "visitors", zero.alias("sessions"), zero.alias("bounces"), "pageviews", "events").unionByName(
        starts.select(*by, "date", zero.alias("visitors"), "sessions", "bounces", zero.alias("pageviews"), zero.alias("events")))
    names = ["visitors", "sessions", "bounces", "pageviews", "events"]
    return rates(both.groupBy(*by, "date").agg(*[F.sum(c).alias(c) for c in names]))
