"""Stored distinct-count sketches (AGG-12 and SRC-14 at scale).

Exact distinct counts over a sliding month meet every (user, day) again in each
run. Here each day keeps one HyperLogLog sketch per group, stored by month;
months and trailing windows are unions of at most as many sketches as they have
days, so their work does not depend on the number of users. A union takes the
same value twice without counting it twice: late events merge into their day's
sketch, and a batch that is replayed, or an event that lands again, changes
nothing.

The relative deviation of an estimate is 1.04 / sqrt(2 ** lg_config_k) (0.8 % at
14), ``error_bound`` is four of these. Small counts are almost exact. NULL values
are not counted; a group with only NULLs on a day still has the day, with 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..session import ensure_runtime_conf, remove_path
from .facts import _exists, month_bounds, read_months, required_keys, staged, write_partitioned

LG_CONFIG_K = 14


def error_bound(lg_config_k: int = LG_CONFIG_K) -> float:
    """Four standard deviations of a relative error."""
    return 4 * 1.04 / math.sqrt(2 ** lg_config_k)


def daily_sketches(df: DataFrame, value: str, date: Column | str, by: Sequence[str] = (),
                   lg_config_k: int = LG_CONFIG_K) -> DataFrame:
    """``(by, date, sketch, n_rows)``: one row per group and day, reduced map-side,
    so a hot day or group is a few sketches when it is shuffled."""
    day = F.col(date) if isinstance(date, str) else date
    return df.groupBy(*by, day.cast("date").alias("date")).agg(
        F.hll_sketch_agg(value, lg_config_k).alias("sketch"), F.count(F.lit(1)).alias("n_rows"))


def merge_sketches(spark: SparkSession, path: str, sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Union daily sketches into the table at ``path``; returns the touched months.

    Only months of the batch are read and rewritten, after the merged rows are
    staged below ``spark.checkpoint.dir``. ``n_rows`` is not stored: it would
    count replayed rows again. A NULL date fails the job.
    """
    ensure_runtime_conf(spark)
    new = required_keys(sketches, ["date"]).select(*by, "date", "sketch", month_key(F.col("date")).alias("month"))
    new, stage = staged(new, "sketches")           # events are read once, for months and sketches alike
    touched = new.select("month").distinct()
    bounds = month_bounds(touched)
    if bounds is not None:
        there = _exists(spark, path)
        both = new
        if there:
            old = read_months(spark, path, *bounds).join(F.broadcast(touched), "month", "left_semi")
            both = new.unionByName(old.select(*new.columns).withColumn("month", F.col("month").cast("string")))
        merged = both.groupBy(*by, "date", "month").agg(F.hll_union_agg("sketch", True).alias("sketch"))
        if there:                                  # cut lineage: the merge reads the partitions it replaces
            merged, merged_stage = staged(merged, "sketches-merged")
        write_partitioned(merged, path)
        if there:
            remove_path(spark, merged_stage)
    months = spark.createDataFrame([(r["month"],) for r in touched.collect()], "month string")    # one per calendar month
    remove_path(spark, stage)
    return months


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; ``month`` as text."""
    df = spark.read.parquet(path)
    return df.withColumn("month", F.col("month").cast("string"))


def distinct_by_month(sketches: DataFrame, by: Sequence[str] = (), out: str = "n_distinct") -> DataFrame:
    """Estimated distinct values per group and month: a union of its days' sketches."""
    return sketches.groupBy(*by, month_key(F.col("date")).alias("month")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias(out))


def trailing_distinct(sketches: DataFrame, window_days: int = 30, by: Sequence[str] = (), out: str = "n_distinct") -> DataFrame:
    """Estimated distinct values of the trailing ``window_days`` days, for every
    calendar day between a group's first and last one."""
    by = list(by)
    span = sketches.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    calendar = span.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.explode(F.sequence("_lo", "_hi")).alias("_day"))
    same = calendar["_day"] == sketches["date"]
    for i, c in enumerate(by):
        same = same & calendar[f"_k{i}"].eqNullSafe(sketches[c])
    days = calendar.join(sketches, same, "left").select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], F.col("_day").alias("date"), "sketch")
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-(window_days - 1), 0)
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch", True).over(w))
    return days.select(*by, "date", F.coalesce(estimate, F.lit(0)).alias(out))


def compare(exact: DataFrame, approx: DataFrame, keys: Sequence[str], value: str, estimate: str,
            lg_config_k: int = LG_CONFIG_K) -> DataFrame:
    """Exact and estimated counts side by side: ``rel_error`` and whether it is within ``error_bound``."""
    j = exact.join(approx, list(keys), "full")
    miss = F.abs(F.col(estimate) - F.col(value))
    within = miss <= F.greatest(F.lit(1.0), F.col(value) * F.lit(error_bound(lg_config_k)))
    return j.select(*exact.columns, estimate, (miss / F.greatest(F.col(value), F.lit(1))).alias("rel_error"),
                    F.coalesce(within, F.lit(False)).alias("within_bound"))
