"""Streaming refresh of the fact tables (STR-1, STR-2, STR-3).

The reference re-runs a fetch-and-write job on a timer. Here landed daily
fact files are a file-source stream; each micro-batch is upserted into the
month-partitioned daily table (keyed on date, idempotent on replay). The
touched months' stored partial aggregates are rewritten from their own daily
rows, and the monthly table is derived from the partials from the earliest
touched month onward (later months depend on earlier ones through new-customer
counts).

``trigger='availableNow'`` processes everything landed so far in bounded
batches and stops (the daily cron form); ``trigger='1 day'`` or any
processing-time interval keeps running (the scheduler form).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facts import _exists, schema_with_month, upsert_table, write_partitioned
from ..operators.rollup import DEAL_STATES, month_partials, monthly_from_partials
from ..schemas import DAILY_SCHEMA, MONTHLY_SCHEMA


def partials_path(monthly_path: str) -> str:
    """Where the partial aggregates of the monthly table at ``monthly_path`` are kept."""
    return f"{monthly_path.rstrip('/')}_partials"


def partials_schema(schema: T.StructType = DAILY_SCHEMA, by: Sequence[str] = ()) -> T.StructType:
    double = {"visitors_avg": T.LongType(), "gwh": T.DoubleType(), "provision": T.DoubleType(), "licenses": T.DoubleType()}
    names = ["visitors_sum", "visitors_avg", "customers_end", "gwh", "provision", "licenses", "total_end",
             *[f"{s}_end" for s in DEAL_STATES], "mau", "impressions_sum", "views_sum"]
    return T.StructType([schema[b] for b in by] + [T.StructField(n, double.get(n, T.LongType())) for n in names]
                        + [T.StructField("month", T.StringType())])


def partials_of_months(spark: SparkSession, facts_path: str, months: Sequence[str], schema: T.StructType = DAILY_SCHEMA,
                       by: Sequence[str] = ()) -> DataFrame:
    """Partial aggregates of some months from these months' fact partitions alone (literal list, so the scan prunes)."""
    facts = spark.read.schema(schema_with_month(schema)).parquet(facts_path).where(F.col("month").isin(*months))
    return month_partials(facts.drop("month"), by)


def recompute_months(spark: SparkSession, facts_path: str, monthly_path: str, touched: DataFrame,
                     schema: T.StructType = DAILY_SCHEMA, by: Sequence[str] = ()) -> None:
    """STR-3: apply changed daily rows to the monthly table.

    The touched months' partial aggregates are rewritten from these months'
    daily rows; no other daily row is read, however far back a late day lies.
    Later months depend on earlier ones through new-customer counts only, and
    those are recomputed from the stored partials (one row per month and
    group). A monthly table without stored partials gets them once from all
    facts.
    """
    months = sorted(r["month"] for r in touched.distinct().collect())      # one per calendar month at most
    if not months:
        return
    by, stored = list(by), partials_path(monthly_path)
    if _exists(spark, monthly_path) and not _exists(spark, stored):
        every = spark.read.schema(schema_with_month(schema)).parquet(facts_path).drop("month")
        write_partitioned(month_partials(every, by), stored, "month")
    else:
        write_partitioned(partials_of_months(spark, facts_path, months, schema, by), stored, "month")
    partials = spark.read.schema(partials_schema(schema, by)).parquet(stored)
    monthly = monthly_from_partials(partials, by).where(F.col("month") >= F.lit(months[0]))
    write_partitioned(monthly, monthly_path, "month")


def monthly_schema(schema: T.StructType = DAILY_SCHEMA, by: Sequence[str] = ()) -> T.StructType:
    """Schema of the monthly table: the grouping keys as in the daily schema, then the monthly columns."""
    return T.StructType([schema[b] for b in by] + MONTHLY_SCHEMA.fields)


def refresh_batch(batch: DataFrame, facts_path: str, monthly_path: str, schema: T.StructType = DAILY_SCHEMA,
                  by: Sequence[str] = ()) -> None:
    """One micro-batch: upsert of the daily rows keyed on ``by`` and date, then monthly recompute per ``by``.

    The batch is read several times (touched months, merge, recompute), so it
    is cached for the duration of the batch (a micro-batch is bounded by the
    trigger's file limit) and released afterwards.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        touched = upsert_table(spark, facts_path, batch, [*by, "date"], "seq", schema=schema)
        recompute_months(spark, facts_path, monthly_path, touched, schema, by)
    finally:
        batch.unpersist()


def start_refresh(spark: SparkSession, landing_path: str, facts_path: str, monthly_path: str, checkpoint_path: str,
                  schema: T.StructType = DAILY_SCHEMA, trigger: str = "availableNow", max_files: int | None = None,
                  by: Sequence[str] = ()):
    """Start the refresh stream; returns the ``StreamingQuery``. ``by``: grouping keys in ``schema``, e.g. a tenant."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(landing_path)
    writer = (stream.writeStream
              .foreachBatch(lambda df, _epoch: refresh_batch(df, facts_path, monthly_path, schema, by))
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def read_monthly(spark: SparkSession, monthly_path: str, schema: T.StructType = DAILY_SCHEMA,
                 by: Sequence[str] = ()) -> DataFrame:
    kind = monthly_schema(schema, by)
    if not _exists(spark, monthly_path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(monthly_path).select(*kind.fieldNames())
