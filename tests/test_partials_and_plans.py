"""Stored partial aggregates, and plans without sorted aggregation."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import facts, rollup, windows
from kpiforge.plans import base
from kpiforge.plans.catalog import QUERIES
from kpiforge.schemas import DAILY_SCHEMA
from kpiforge.session import scratch_path
from kpiforge.streaming import refresh


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_a_late_day_reads_its_own_month_only(spark, sf_small):
    root = scratch_path(spark, "late-test")
    daily = base.daily_from_orders(spark, sf_small)
    months = sorted(r.month for r in daily.select(F.date_format("date", "yyyy-MM").alias("month")).distinct().collect())
    late = months[len(months) // 2]
    is_late = (F.date_format("date", "yyyy-MM") == late) & (F.dayofmonth("date") > 20)
    refresh.refresh_batch(daily.where(~is_late), f"{root}/facts", f"{root}/monthly")
    refresh.refresh_batch(daily.where(is_late), f"{root}/facts", f"{root}/monthly")
    assert rows_of(refresh.read_monthly(spark, f"{root}/monthly")) == rows_of(rollup.monthly_rollup(daily))
    again = refresh.partials_of_months(spark, f"{root}/facts", [late])
    # reading any other month would fail: here is one that is no Parquet at all
    spark.createDataFrame([("x",)], "v string").write.text(f"{root}/facts/month=1900-01")
    assert again.count() == 1
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*month", plan) and "SortAggregate" not in plan
    # a corrected day replaces its old values in the partials too
    day = daily.where(F.date_format("date", "yyyy-MM") == late).limit(1).withColumn("ga_visitors", F.lit(10_000).cast("bigint")).withColumn("seq", F.col("seq") + 9)
    before = {r["month"]: r for r in refresh.read_monthly(spark, f"{root}/monthly").collect()}
    refresh.refresh_batch(day, f"{root}/facts", f"{root}/monthly")
    after = {r["month"]: r for r in refresh.read_monthly(spark, f"{root}/monthly").collect()}
    assert [m for m in months if before[m] != after[m]] == [late] and after[late]["ga_visitors_sum"] >= 10_000


def test_partials_of_an_older_monthly_table(spark, sf_small):
    root = scratch_path(spark, "old-monthly-test")
    daily = base.daily_from_orders(spark, sf_small)
    new = F.year("date") >= 1997
    facts.upsert_table(spark, f"{root}/facts", daily.where(~new), schema=DAILY_SCHEMA)
    facts.write_partitioned(rollup.monthly_rollup(daily.where(~new)), f"{root}/monthly")
    refresh.refresh_batch(daily.where(new), f"{root}/facts", f"{root}/monthly")
    assert rows_of(refresh.read_monthly(spark, f"{root}/monthly")) == rows_of(rollup.monthly_rollup(daily))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["monthly_rollup", "tenant_monthly_rollup", "monthly_rollup_variant", "merge_sources", "upsert_daily",
                                  "tenant_upsert", "kpis_collected"])
def test_no_sorted_aggregation(spark, sf_small, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, sf_small))


def test_packed_order_is_date_then_seq_with_null_first(spark):
    d = dt.date
    rows = [(d(1, 1, 1), 5), (d(2024, 1, 1), -(1 << 63)), (d(2024, 1, 1), (1 << 63) - 1), (d(2024, 1, 1), None), (d(2024, 1, 2), None),
            (None, 7), (None, None), (d(9999, 12, 31), 0), (d(1969, 12, 31), 3)]
    df = spark.createDataFrame(rows, "date date, seq long")
    got = [tuple(r)[:2] for r in df.select("date", "seq", rollup.order_key(df).alias("k")).orderBy("k").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or d.min, r[1] is not None, r[1] or 0))
    assert rollup.order_key(df)._jc.toString() != rollup.order_key(df.withColumn("seq", F.col("seq").cast("string")))._jc.toString()


@pytest.mark.parametrize("text", [False, True])
def test_one_row_per_key_stays_whole(spark, text):
    rows = [("a", 1, 5, 1.0), ("a", None, 3, None), ("a", 9, None, 2.5), ("b", None, 8, 8.0), ("c", -4, 1, None), ("c", -2, 2, 7.0)]
    df = spark.createDataFrame(rows, "k string, seq long, x long, y double")
    if text:
        df = df.withColumn("t", F.col("x").cast("string"))
    last = {r.k: (r.seq, r.x, r.y) for r in windows.last_per_key(df, ["k"], "seq").collect()}
    first = {r.k: (r.seq, r.x, r.y) for r in windows.first_per_key(df, ["k"], "seq").collect()}
    assert last == {"a": (9, None, 2.5), "b": (None, 8, 8.0), "c": (-2, 2, 7.0)}
    assert first == {"a": (None, 3, None), "b": (None, 8, 8.0), "c": (-4, 1, None)}
