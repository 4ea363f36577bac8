import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import facts
from kpiforge.schemas import DAILY_SCHEMA, LEADS_SCHEMA, enforce_schema
from kpiforge.session import scratch_path
from kpiforge.sources.tables import load_daily
from tests.conftest import rows
from tests.test_rollup_windows import daily

D = dt.date


def _tbl(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_replaces_first_match_and_dedupes(spark):
    existing = daily(spark, [
        {"date": D(2026, 1, 1), "ga_visitors": 1, "li_views": 5, "seq": 1},
        {"date": D(2026, 1, 1), "ga_visitors": 2, "li_views": 6, "seq": 2},
        {"date": D(2026, 1, 2), "ga_visitors": 3, "li_views": 7, "seq": 3},
        {"date": D(2026, 1, 2), "ga_visitors": 4, "li_views": 8, "seq": 4},
    ])
    updates = daily(spark, [
        {"date": D(2026, 1, 1), "ga_visitors": 10, "li_views": None, "seq": 10},
        {"date": D(2026, 1, 1), "ga_visitors": 11, "li_views": None, "seq": 11},
        {"date": D(2026, 1, 3), "ga_visitors": 12, "li_views": None, "seq": 12},
    ])
    out = facts.upsert(existing, updates, ["date"])
    got = rows(out.select("date", "ga_visitors", "li_views", "ga_sessions"), ["date", "ga_visitors"])
    assert got == [
        {"date": D(2026, 1, 1), "ga_visitors": 11, "li_views": 5, "ga_sessions": 0},  # latest update, NULL keeps first
        {"date": D(2026, 1, 2), "ga_visitors": 3, "li_views": 7, "ga_sessions": None},  # untouched keys keep all rows
        {"date": D(2026, 1, 2), "ga_visitors": 4, "li_views": 8, "ga_sessions": None},
        {"date": D(2026, 1, 3), "ga_visitors": 12, "li_views": 0, "ga_sessions": 0},   # new key, defaults
    ]
    twice = facts.upsert(out, updates, ["date"])
    assert _tbl(twice) == _tbl(out)       # idempotent


def test_upsert_parity_mode_overwrites_with_defaults(spark):
    existing = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 1, "li_views": 5}])
    updates = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 2, "li_views": None}])
    r = rows(facts.upsert(existing, updates, ["date"], keep_existing_on_null=False))[0]
    assert (r["ga_visitors"], r["li_views"]) == (2, 0)


def test_backfill_never_changes_existing(spark):
    existing = daily(spark, [{"date": D(2026, 1, 2), "ga_visitors": 1, "notion_customers_total": 70}])
    history = spark.createDataFrame([(D(2026, 1, 1), 5, 6, 40.0), (D(2026, 1, 2), 99, 99, 1.0)],
                                    "date date, ga_visitors bigint, ga_sessions bigint, ga_bounce_rate double")
    out = rows(facts.backfill(existing, history), ["date"])
    assert len(out) == 2
    assert out[0]["ga_visitors"] == 5 and out[0]["notion_customers_total"] == 0 and out[0]["ga_bounce_rate"] == 40.0
    assert out[1]["ga_visitors"] == 1 and out[1]["notion_customers_total"] == 70


def test_merge_sources_later_wins(spark):
    a = spark.createDataFrame([(D(2026, 1, 1), 1, 2), (D(2026, 1, 2), 3, 4)], "date date, x bigint, y bigint")
    b = spark.createDataFrame([(D(2026, 1, 2), 40, 50), (D(2026, 1, 3), 60, 70)], "date date, y bigint, z bigint")
    out = rows(facts.merge_sources([a, b]), ["date"])
    assert [(r["x"], r["y"], r["z"]) for r in out] == [(1, 2, 0), (3, 40, 50), (0, 60, 70)]


def test_upsert_table_rewrites_only_touched_months(spark):
    path = scratch_path(spark, "facts-test")
    first = daily(spark, [{"date": D(2026, 1, 5), "ga_visitors": 1}, {"date": D(2026, 2, 5), "ga_visitors": 2}])
    facts.upsert_table(spark, path, first, schema=DAILY_SCHEMA)
    upd = daily(spark, [{"date": D(2026, 2, 5), "ga_visitors": 20}, {"date": D(2026, 2, 6), "ga_visitors": 21}])
    touched = [r.month for r in facts.upsert_table(spark, path, upd, schema=DAILY_SCHEMA).collect()]
    assert touched == ["2026-02"]
    back = spark.read.parquet(path)
    got = sorted((r.date, r.ga_visitors) for r in back.collect())
    assert got == [(D(2026, 1, 5), 1), (D(2026, 2, 5), 20), (D(2026, 2, 6), 21)]
    facts.upsert_table(spark, path, upd, schema=DAILY_SCHEMA)      # replay is harmless
    assert sorted((r.date, r.ga_visitors) for r in spark.read.parquet(path).collect()) == got


def test_snapshot_missing_is_empty_and_schema_drift_fails(spark):
    missing = facts.read_snapshot(spark, scratch_path(spark, "nothing"), LEADS_SCHEMA)
    assert missing.count() == 0 and missing.schema == LEADS_SCHEMA
    bad = spark.createDataFrame([("x",)], "name string")
    with pytest.raises(ValueError):
        enforce_schema(bad, LEADS_SCHEMA)
    loose = enforce_schema(bad, LEADS_SCHEMA, strict=False)
    assert loose.columns == LEADS_SCHEMA.fieldNames()


def test_text_table_round_trip(spark):
    path = scratch_path(spark, "daily-csv")
    src = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 1234, "ga_bounce_rate": 41.5}])
    src.select(*[F.col(c).cast("string") for c in src.columns]).write.option("header", True).csv(path)
    back = rows(load_daily(spark, path))[0]
    assert back["ga_visitors"] == 1234 and back["ga_bounce_rate"] == 41.5 and back["li_views"] == 0


def test_monthly_upsert_keyed_by_month(spark):
    # SNK-4: the same first-match/dedupe rule keyed by month
    old = spark.createDataFrame([("2026-01", 10, 1), ("2026-01", 11, 2), ("2026-02", 5, 3)],
                                "month string, ga_visitors_sum bigint, seq bigint")
    new = spark.createDataFrame([("2026-01", 99, 9)], "month string, ga_visitors_sum bigint, seq bigint")
    out = sorted((r.month, r.ga_visitors_sum) for r in facts.upsert(old, new, ["month"]).collect())
    assert out == [("2026-01", 99), ("2026-02", 5)]


def test_load_monthly_text(spark):
    from kpiforge.sources.tables import load_monthly
    path = scratch_path(spark, "monthly-csv")
    spark.createDataFrame([("2026-01", "1.234,5", "12")], "month string, notion_provision_eur string, ga_visitors_sum string") \
        .write.option("header", True).csv(path)
    r = rows(load_monthly(spark, path))[0]
    assert r["month"] == "2026-01" and r["notion_provision_eur"] == 1234.5 and r["ga_visitors_sum"] == 12
    assert r["li_views_sum"] is None      # absent column -> typed NULL (PRJ-6); an empty cell parses as 0


def test_kpis_collected_and_table_counts(spark):
    from kpiforge.operators.reports import kpis_collected, table_counts
    d = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 1, "li_views": None},
                      {"date": D(2026, 1, 2), "ga_visitors": 2, "li_views": 3}])
    assert rows(kpis_collected(d, ["ga_visitors", "li_views", "auth0_mau"])) == [{"kpis_collected": 2}]
    out = rows(table_counts({"a": d, "b": None}, ["a", "b"]), ["pos"])
    assert [(r["table_name"], r["present"], r["n_rows"]) for r in out] == [("a", True, 2), ("b", False, 0)]


def test_text_table_keeps_group_keys(spark):
    path = scratch_path(spark, "daily-csv-tenant")
    spark.createDataFrame([("t1", "2026-01-01", "5")], "tenant string, date string, ga_visitors string") \
        .write.option("header", True).csv(path)
    r = rows(load_daily(spark, path))[0]
    assert r["tenant"] == "t1" and r["ga_visitors"] == 5 and r["date"] == D(2026, 1, 1)
