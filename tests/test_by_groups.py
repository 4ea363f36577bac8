"""Grouping keys: an operator run with ``by=["tenant"]`` over several tenants
equals the operator run on each tenant alone."""
import pytest
from pyspark.sql import functions as F

from kpiforge.operators import reports, rollup, windows
from kpiforge.plans import base
from kpiforge.sources import events as ev


def _norm(rows_):
    return sorted(tuple(r) for r in rows_)


@pytest.fixture(scope="module")
def two_tenants(spark, sf_small):
    d = base.daily_from_orders(spark, sf_small)
    a = d.withColumn("tenant", F.lit("a"))
    b = d.where(F.dayofmonth("date") % 2 == 0).withColumn("tenant", F.lit("b")) \
        .withColumn("ga_visitors", F.col("ga_visitors") * 3)
    return a.unionByName(b)


OPS = {
    "monthly_rollup": lambda df, by: rollup.monthly_rollup(df, by=by),
    "monthly_rollup_variant": lambda df, by: rollup.monthly_rollup_variant(df, by=by),
    "period_sum_delta": lambda df, by: windows.period_sum_delta(df, ["ga_visitors"], by=by),
    "trailing_sum_series": lambda df, by: windows.trailing_sum_series(df, "ga_visitors", 7, by=by),
    "offset_delta": lambda df, by: windows.offset_delta(df, "ga_visitors", 7, by=by),
    "last_known_delta": lambda df, by: windows.last_known_delta(df, "notion_customers_total", by=by),
    "trailing_range": lambda df, by: windows.trailing_range(df, 30, by=by, cols=["date", "ga_visitors"]),
    "kpi_cards": lambda df, by: reports.kpi_cards(df, None, 30, by=by),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_grouped_equals_per_group(spark, two_tenants, name):
    op = OPS[name]
    grouped = op(two_tenants, ["tenant"])
    for t in ("a", "b"):
        alone = op(two_tenants.where(F.col("tenant") == t).drop("tenant"), [])
        got = grouped.where(F.col("tenant") == t).drop("tenant").select(*alone.columns)
        assert _norm(got.collect()) == _norm(alone.collect()), (name, t)


def test_events_by_group(spark, sf_small):
    e = base.read(spark, sf_small, "events")
    tagged = e.withColumn("site", F.when(F.col("user_id") % 3 == 0, "x").otherwise("y"))
    for op in (lambda df, by: ev.daily_metrics(df, by=by), lambda df, by: ev.monthly_active_users(df, by=by)):
        grouped = op(tagged, ["site"])
        for s in ("x", "y"):
            alone = op(tagged.where(F.col("site") == s).drop("site"), [])
            got = grouped.where(F.col("site") == s).drop("site").select(*alone.columns)
            assert _norm(got.collect()) == _norm(alone.collect())
