"""Batch jobs of the daily pipeline.

``refresh_once``: per-source daily KPI frames -> merged on date (JON-1) ->
keyed upsert into the month-partitioned fact table (SNK-1) -> monthly
recompute from the earliest touched month (AGG-6, STR-3). This is the
batch form of the streaming refresh; a scheduler (or an ``availableNow``
trigger) runs it.

``backfill_table``: history rows for days not yet present are appended
(SNK-2); existing days are never touched; months that received rows are
recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_key
from ..operators.facts import (_exists, fill_defaults, merge_sources, month_bounds, one_per_key, read_months,
                               staged)
from ..schemas import DAILY_SCHEMA, with_missing
from ..session import remove_path
from .refresh import recompute_months, refresh_batch


def refresh_once(spark: SparkSession, sources: Sequence[DataFrame], facts_path: str, monthly_path: str,
                 seq: int, schema: T.StructType = DAILY_SCHEMA, by: Sequence[str] = ()) -> None:
    """Merge today's per-source frames and apply them to the fact tables.

    ``seq`` orders this run's rows after earlier runs (arrival order); a
    source missing a KPI leaves NULL, which keeps the stored value.
    """
    merged = merge_sources(list(sources), [*by, "date"], fill=False)
    rows = with_missing(merged, schema).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name != "seq"],
                                               F.lit(seq).cast("bigint").alias("seq"))
    refresh_batch(rows, facts_path, monthly_path, schema, by)


def backfill_table(spark: SparkSession, facts_path: str, monthly_path: str, history: DataFrame,
                   seq: int, schema: T.StructType = DAILY_SCHEMA, by: Sequence[str] = ()) -> DataFrame:
    """Append history rows for days (per ``by``) not in the fact table, each key
    once (other KPIs get their defaults); returns the months that received rows.

    Only the key columns of the history's months are read for the check
    (column and partition pruning). The new rows are staged before they
    are appended to the table they were checked against.
    """
    keys = [*by, "date"]
    hist = one_per_key(with_missing(history, schema), keys).select(
        *[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name != "seq"],
        F.lit(seq).cast("bigint").alias("seq")).withColumn("month", month_key(F.col("date")))
    bounds = month_bounds(hist)
    if bounds is not None and _exists(spark, facts_path):
        there = read_months(spark, facts_path, *bounds, schema=schema).select(*keys).distinct()
        hist = hist.join(there, keys, "left_anti").select(*hist.columns)
    new = fill_defaults(hist, [f.name for f in schema.fields if f.name not in (*keys, "seq")])
    new, stage = staged(new, "backfill")
    new.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(facts_path)
    months = [(r["month"],) for r in new.select("month").distinct().collect()]     # one per calendar month at most
    remove_path(spark, stage)
    touched = spark.createDataFrame(months, "month string")
    if months:
        recompute_months(spark, facts_path, monthly_path, touched, schema, by)
    return touched
