import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import rollup, windows
from kpiforge.schemas import DAILY_SCHEMA, with_missing
from tests.conftest import rows

D = dt.date


def daily(spark, recs, extra_cols=()):
    cols = ["date", *extra_cols, "seq"]
    kpis = sorted({k for r in recs for k in r if k not in cols})
    schema = ", ".join(["date date", *[f"{c} string" for c in extra_cols]]
                       + [f"{k} {'double' if DAILY_SCHEMA[k].dataType.typeName() == 'double' else 'bigint'}"
                          for k in kpis] + ["seq bigint"])
    data = [tuple(r.get(c) for c in ["date", *extra_cols, *kpis]) + (r.get("seq", i),) for i, r in enumerate(recs)]
    return with_missing(spark.createDataFrame(data, schema), DAILY_SCHEMA)


def test_new_customers_rule_table(spark):
    # FIXTURES §3: Jan 70, Feb 0 (unknown), Mar 78 -> 70 / 0 / 8; Feb 65 after Jan 70 -> 0
    d = daily(spark, [
        {"date": D(2026, 1, 5), "notion_customers_total": 70},
        {"date": D(2026, 2, 5), "notion_customers_total": 0},
        {"date": D(2026, 3, 5), "notion_customers_total": 78},
        {"date": D(2026, 4, 5), "notion_customers_total": 65},
    ])
    out = rows(rollup.monthly_rollup(d), ["month"])
    assert [(r["month"], r["notion_customers_end"], r["notion_customers_new"]) for r in out] == [
        ("2026-01", 70, 70), ("2026-02", 0, 0), ("2026-03", 78, 8), ("2026-04", 65, 0)]


def test_last_known_and_gated_last(spark):
    d = daily(spark, [
        {"date": D(2026, 1, 1), "notion_customers_total": 5, "notion_yearly_consumption_gwh": 1.5,
         "zoho_deals_total": 10, "ga_visitors": 3, "auth0_mau": 7, "manual_license_revenue": 0.1},
        {"date": D(2026, 1, 2), "notion_customers_total": 6, "notion_yearly_consumption_gwh": 0.0,
         "zoho_deals_total": 0, "ga_visitors": 4, "auth0_mau": 9, "manual_license_revenue": 0.2},
        {"date": D(2026, 1, 3), "notion_customers_total": 0, "notion_yearly_consumption_gwh": 9.9,
         "zoho_deals_total": 0, "ga_visitors": 4, "auth0_mau": 2, "manual_license_revenue": None},
    ])
    r = rows(rollup.monthly_rollup(d))[0]
    assert r["notion_customers_end"] == 6
    assert r["notion_yearly_consumption_gwh"] == 0.0      # gated by the last row with customers, even if 0
    assert r["zoho_deals_total_end"] == 10                 # last row with a known (> 0) value
    assert r["ga_visitors_sum"] == 11 and r["ga_visitors_avg"] == 3   # 11/3 truncated
    assert r["auth0_mau_end"] == 9 and r["manual_license_revenue"] == pytest.approx(0.3)
    assert r["zoho_deals_won_end"] == 0                    # never known -> 0


def test_order_is_date_then_seq_not_arrival(spark):
    # a backfilled (earlier) day arriving last must not become "last" (Q3)
    d = daily(spark, [
        {"date": D(2026, 1, 10), "notion_customers_total": 50, "seq": 1},
        {"date": D(2026, 1, 2), "notion_customers_total": 40, "seq": 2},
        {"date": D(2026, 1, 10), "notion_customers_total": 55, "seq": 0},
    ])
    assert rows(rollup.monthly_rollup(d))[0]["notion_customers_end"] == 50


def test_rollup_by_tenant_and_month_filter(spark):
    d = daily(spark, [
        {"date": D(2026, 1, 1), "tenant": "a", "notion_customers_total": 10, "ga_visitors": 1},
        {"date": D(2026, 2, 1), "tenant": "a", "notion_customers_total": 12, "ga_visitors": 2},
        {"date": D(2026, 2, 1), "tenant": "b", "notion_customers_total": 3, "ga_visitors": 5},
    ], extra_cols=("tenant",))
    out = rows(rollup.monthly_rollup(d, by=["tenant"]), ["tenant", "month"])
    assert [(r["tenant"], r["month"], r["notion_customers_new"]) for r in out] == [
        ("a", "2026-01", 10), ("a", "2026-02", 2), ("b", "2026-02", 3)]
    only = rows(rollup.monthly_rollup(d, by=["tenant"], month="2026-02"), ["tenant"])
    assert [(r["tenant"], r["notion_customers_new"]) for r in only] == [("a", 2), ("b", 3)]


def test_monthly_sums_add_up(spark, sf_small):
    from kpiforge.plans import base
    d = base.daily_from_orders(spark, sf_small)
    m = rollup.monthly_rollup(d)
    a = d.agg(F.sum("ga_visitors").alias("v"), F.sum("li_views").alias("l")).first()
    b = m.agg(F.sum("ga_visitors_sum").alias("v"), F.sum("li_views_sum").alias("l")).first()
    assert (a.v, a.l) == (b.v, b.l)


def test_variant_half_even(spark):
    d = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 2, "notion_customers_total": 10},
                      {"date": D(2026, 1, 2), "ga_visitors": 3, "notion_customers_total": 14}])
    r = rows(rollup.monthly_rollup_variant(d))[0]
    assert r["ga_visitors_avg"] == 2 and r["notion_customers_new"] == 4   # bround(2.5) = 2


def _series(spark, values):
    return daily(spark, [{"date": D(2026, 1, 1) + dt.timedelta(days=i), "ga_visitors": v}
                         for i, v in enumerate(values)])


def test_period_sum_delta_guard(spark):
    d = _series(spark, [1, 2, 3, 4, 5])
    out = {r["days"]: r for r in rows(windows.period_sum_delta(d, ["ga_visitors"], periods=(2, 3)))}
    assert (out[2]["current"], out[2]["previous"]) == (9, 5)
    assert out[2]["delta_pct"] == pytest.approx(80.0)
    assert (out[3]["current"], out[3]["previous"], out[3]["delta_pct"]) == (12, 0, None)  # fewer than 2N rows


def test_offset_and_last_known_delta(spark):
    d = _series(spark, [10, 0, 20, 30])
    off = rows(windows.offset_delta(d, "ga_visitors", 1), ["date"])
    assert [(r["delta_abs"], r["delta_pct"]) for r in off] == [(0.0, 0.0), (-10.0, -100.0), (0.0, 0.0), (10.0, 50.0)]
    lk = rows(windows.last_known_delta(d, "ga_visitors"), ["date"])
    assert [(r["value"], r["delta"]) for r in lk] == [(10, None), (20, 10), (30, 10)]


def test_trailing_range_inclusive(spark):
    d = _series(spark, list(range(10)))
    out = rows(windows.trailing_range(d, 3, cols=["date", "ga_visitors"]), ["date"])
    assert len(out) == 4 and out[0]["last_update"] == D(2026, 1, 10) and out[0]["n_days"] == 10


def test_trailing_sum_series(spark):
    d = _series(spark, [1, 1, 1, 1, 2])
    out = rows(windows.trailing_sum_series(d, "ga_visitors", 2), ["date"])
    assert [r["current"] for r in out] == [1, 2, 2, 2, 3]
    assert [r["previous"] for r in out] == [None, None, None, 2, 2]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "z")], "key string, seq int, v string")
    assert rows(windows.first_per_key(df, ["key"], "seq"), ["key"]) == [
        {"key": "j", "seq": 5, "v": "z"}, {"key": "k", "seq": 1, "v": "a"}]
    assert rows(windows.last_per_key(df, ["key"], "seq"), ["key"])[1]["v"] == "b"


def test_seeded_rollup_equals_full_history(spark, sf_small):
    from kpiforge.plans import base
    d = base.daily_from_orders(spark, sf_small)
    full = rollup.monthly_rollup(d)
    cut = "1998-03"
    seed = full.where(F.col("month") < cut).select("month", "notion_customers_end")
    part = rollup.monthly_rollup(d.where(fx_month(d) >= cut), seed=seed)
    want = sorted(tuple(r) for r in full.where(F.col("month") >= cut).collect())
    assert sorted(tuple(r) for r in part.collect()) == want


def fx_month(df):
    return F.date_format("date", "yyyy-MM")
