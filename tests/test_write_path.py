"""The keyed write path: tenants, NULL order and keys, replays, pruning, duplicate history."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import facts, targets
from kpiforge.operators.windows import first_per_key, last_per_key
from kpiforge.schemas import DAILY_SCHEMA
from kpiforge.session import scratch_path
from kpiforge.streaming import jobs, refresh
from tests.conftest import rows
from tests.test_rollup_windows import daily

D = dt.date


def _tenants(spark, recs):
    return daily(spark, [{k: v for k, v in r.items() if k != "tenant"} for r in recs]).withColumn(
        "tenant", F.element_at(F.array(*[F.lit(r["tenant"]) for r in recs]), F.col("seq").cast("int")))


def test_refresh_keeps_tenants_apart(spark):
    root = scratch_path(spark, "tenants")
    b = _tenants(spark, [{"tenant": "a", "date": D(2026, 1, 5), "ga_visitors": 100, "seq": 1},
                         {"tenant": "b", "date": D(2026, 1, 5), "ga_visitors": 200, "seq": 2}])
    for _ in range(2):
        refresh.refresh_batch(b, f"{root}/f", f"{root}/m", b.schema, by=["tenant"])
    got = rows(refresh.read_monthly(spark, f"{root}/m", b.schema, ["tenant"]), ["tenant"])
    assert [(r["tenant"], r["ga_visitors_sum"]) for r in got] == [("a", 100), ("b", 200)]


def test_null_order_keeps_its_row(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 6), (2, None, 7)], "k int, seq bigint, v int")
    assert sorted((r.k, r.v) for r in first_per_key(df, ["k"], "seq").collect()) == [(1, 5), (2, 7)]
    assert sorted((r.k, r.v) for r in last_per_key(df, ["k"], "seq").collect()) == [(1, 6), (2, 7)]


def test_upsert_with_null_order_and_without_order_column(spark):
    old = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 10, "li_views": 5, "seq": None}])
    new = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 99, "seq": None}, {"date": D(2026, 1, 2), "ga_visitors": 77, "seq": None}])
    got = rows(facts.upsert(old, new, ["date"]), ["date"])
    assert [(r["ga_visitors"], r["li_views"]) for r in got] == [(99, 5), (77, 0)]
    with pytest.raises(ValueError):
        facts.upsert(old, new.drop("seq"), ["date"])


def test_null_key_in_updates_fails_and_stays_in_existing(spark):
    old = daily(spark, [{"date": None, "ga_visitors": 1, "seq": 1}, {"date": D(2026, 1, 1), "ga_visitors": 2, "seq": 2}])
    new = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 3, "seq": 3}])
    assert sorted((r.ga_visitors for r in facts.upsert(old, new, ["date"]).collect())) == [1, 3]
    with pytest.raises(Exception, match="NULL in key column date"):
        facts.upsert(new, old, ["date"]).collect()


def test_replay_with_nulls_changes_nothing(spark):
    root = scratch_path(spark, "replay")
    b = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 100, "seq": 1}, {"date": D(2026, 1, 2), "ga_visitors": None, "seq": 2}])
    seen = []
    for _ in range(2):
        refresh.refresh_batch(b, f"{root}/f", f"{root}/m")
        seen.append((sorted(map(tuple, spark.read.parquet(f"{root}/f").collect())),
                     [tuple(r) for r in refresh.read_monthly(spark, f"{root}/m").collect()]))
    assert seen[0] == seen[1]


def test_only_months_of_the_batch_are_read(spark):
    path = f"{scratch_path(spark, 'pruned')}/f"
    days = [{"date": D(2026, m, 3), "ga_visitors": m, "seq": m} for m in range(1, 7)]
    facts.upsert_table(spark, path, daily(spark, days), schema=DAILY_SCHEMA)
    read = facts.read_months(spark, path, "2026-02", "2026-03", DAILY_SCHEMA)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "(month" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "2026-03" in plan
    assert len(read.inputFiles()) < len(spark.read.parquet(path).inputFiles()) + 1 and read.count() == 2


def test_history_days_are_appended_once(spark):
    root = scratch_path(spark, "history")
    old = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 1, "seq": 1}])
    refresh.refresh_batch(old, f"{root}/f", f"{root}/m")
    history = spark.createDataFrame([(D(2026, 1, 2), 5), (D(2026, 1, 2), 5)], "date date, ga_visitors bigint")
    jobs.backfill_table(spark, f"{root}/f", f"{root}/m", history, seq=2)
    assert rows(refresh.read_monthly(spark, f"{root}/m"))[0]["ga_visitors_sum"] == 6
    assert facts.backfill(old.drop("seq"), history).count() == 2


def test_merge_sources_with_repeated_keys(spark):
    a = spark.createDataFrame([(D(2026, 1, 1), 1), (D(2026, 1, 1), 2)], "date date, x bigint")
    b = spark.createDataFrame([(D(2026, 1, 1), 3), (D(2026, 1, 1), None)], "date date, y bigint")
    assert [tuple(r) for r in facts.merge_sources([a, b]).collect()] == [(D(2026, 1, 1), 2, 3)]


def test_group_without_rows_in_the_year_has_zero(spark):
    d = _tenants(spark, [{"tenant": "a", "date": D(2026, 1, 1), "ga_visitors": 4, "seq": 1},
                         {"tenant": "b", "date": D(2025, 1, 1), "ga_visitors": 9, "seq": 2}])
    got = {(r.tenant, r.kpi): r.ytd for r in targets.ytd_values(d, None, 2026, ["ga_visitors"], by=["tenant"]).collect()}
    assert got == {("a", "ga_visitors"): 4.0, ("b", "ga_visitors"): 0.0}


def test_targets_need_an_order(spark):
    with pytest.raises(ValueError):
        targets.first_targets(spark.createDataFrame([("a", 1.0)], "kpi string, target_yearly double"))
