"""Counts and bounds from Parquet footers: plans without a row scan, NULLs, empty and missing tables."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from kpiforge.session import scratch_path
from kpiforge.sources import footers


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def days(spark):
    """100 days by month; ``y`` has NULLs, ``none`` only NULLs, ``half`` none in January and only NULLs in February."""
    path = scratch_path(spark, "footers-test")
    df = spark.range(100).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), "id",
                                 F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("y"), F.lit(None).cast("date").alias("none"),
                                 F.when(F.col("id") < 31, F.col("id")).alias("half"), F.col("id").cast("double").alias("x"))
    df.withColumn("month", F.date_format("date", "yyyy-MM")).repartition(3).write.partitionBy("month").parquet(path)
    return path


def test_stats_read_no_rows(spark, days):
    s = footers.table_stats(spark, days, ["date", "id"], ["y", "none"])
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date), MIN(id), MAX(id), COUNT(y), COUNT(none)]" in plan_of(s)
    assert "FileScan" not in plan_of(s)
    assert [tuple(r) for r in s.collect()] == [(100, dt.date(2024, 1, 1), dt.date(2024, 4, 9), 0, 99, 66, 0)]


def test_stats_by_partition(spark, days):
    s = footers.table_stats(spark, days, ["date"], ["y"], by=["month"])
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(date\).*PushedGroupBy: \[month\]", plan_of(s))
    want = spark.read.parquet(days).groupBy("month").agg(F.count(F.lit(1)), F.min("date"), F.max("date"), F.count("y"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("by", [[], ["month"]])
def test_bounds_of_columns_with_nulls(spark, days, by):
    """A footer of a file with only NULLs has no bound; such columns are scanned."""
    s = footers.table_stats(spark, days, ["y", "date", "none", "half"], ["half"], by=by)
    want = spark.read.parquet(days).groupBy(*by).agg(
        F.count(F.lit(1)), *[f(c) for c in ("y", "date", "none", "half") for f in (F.min, F.max)], F.count("half"))
    assert sorted(map(repr, map(tuple, s.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_the_callers_sources_stay_as_they_are(spark, days):
    before = spark.conf.get(footers._V1_SOURCES)
    footers.read_footers(spark, days)
    with pytest.raises(Exception):
        footers.read_footers(spark, days + "-none")
    assert spark.conf.get(footers._V1_SOURCES) == before
    assert "FileScan parquet" in plan_of(spark.read.parquet(days))


def test_columns_without_exact_bounds_are_refused(spark, days):
    for c in ("x", "month"):
        with pytest.raises(ValueError):
            footers.table_stats(spark, days, [c])


def test_empty_tables(spark):
    path = scratch_path(spark, "footers-empty")
    empty = spark.range(0).select("id", F.lit(None).cast("date").alias("date"))
    empty.write.parquet(path)
    assert [tuple(r) for r in footers.table_stats(spark, path, ["date"], ["id"]).collect()] == [(0, None, None, 0)]
    # an empty file beside one with rows
    spark.createDataFrame([(1, dt.date(2024, 2, 2))], empty.schema).coalesce(1).write.mode("append").parquet(path)
    assert [tuple(r) for r in footers.table_stats(spark, path, ["date"], ["id"]).collect()] == [(1, dt.date(2024, 2, 2), dt.date(2024, 2, 2), 1)]


def test_health_of_missing_and_unnamed_tables(spark, days):
    h = footers.stored_health(spark, {"d": (days, "date"), "n": (days, None), "gone": (days + "-gone", "date")}, ["d", "gone", "n", "unnamed"])
    got = {r.table_name: (r.pos, r.present, r.n_rows, r.first_date, r.last_date) for r in h.collect()}
    assert got == {"d": (1, True, 100, dt.date(2024, 1, 1), dt.date(2024, 4, 9)), "gone": (2, False, 0, None, None),
                   "n": (3, True, 100, None, None), "unnamed": (4, False, 0, None, None)}


def test_months_with_gaps(spark):
    path = scratch_path(spark, "gaps-test")
    df = spark.range(400).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"))
    df = df.where((F.month("date") != 5) & (F.col("date") != dt.date(2024, 2, 29)) & (F.col("date") < dt.date(2024, 12, 20)))
    df.withColumn("month", F.date_format("date", "yyyy-MM")).write.partitionBy("month").parquet(path)
    got = {(r.month, r.days, r.missing) for r in footers.months_with_gaps(spark, path).collect()}
    assert got == {("2024-02", 28, 1), ("2024-05", 0, 31), ("2024-12", 19, 12)}
    wide = {r.month for r in footers.months_with_gaps(spark, path, "2023-12", "2025-01").collect()}
    assert wide == {"2023-12", "2024-02", "2024-05", "2024-12", "2025-01"}
