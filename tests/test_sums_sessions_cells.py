"""Sums without cuts, sessions with anonymous users and groups, and cells that cannot be parsed."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kpiforge.functions.nested import PROPERTY_TYPE, prop_text
from kpiforge.functions.numbers import exact_sum, round_half_up
from kpiforge.sources import events as ev
from kpiforge.sources.tables import typed_from_text
from kpiforge.schemas import DAILY_SCHEMA
from tests.conftest import rows

T = dt.datetime


def _sum(spark, values, digits=None):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x", digits).alias("s")).first()["s"]


def test_exact_sum_keeps_small_and_odd_values(spark):
    assert _sum(spark, [1e-10] * 10) == pytest.approx(1e-9, rel=1e-12)
    assert _sum(spark, [0.1] * 10) == 1.0 and _sum(spark, [0.005, 0.01], 2) == 0.02
    assert math.isnan(_sum(spark, [1.0, float("nan")])) and math.isnan(_sum(spark, [float("nan")], 2))
    assert _sum(spark, [1.0, float("inf")]) == math.inf and _sum(spark, [1e30, 1.0]) == 1e30
    assert _sum(spark, [None, 2.5]) == 2.5 and _sum(spark, [None]) is None
    got = spark.createDataFrame([(1.005,), (float("nan"),), (1e30,)], "x double").select(round_half_up("x", 2).alias("r")).collect()
    assert got[0].r == 1.01 and math.isnan(got[1].r) and got[2].r == 1e30


def _events(spark, recs):
    return spark.createDataFrame([(i, t, u, k, s) for i, (t, u, k, s) in enumerate(recs)],
                                 "event_id bigint, ts timestamp, user_id bigint, event_type string, site string")


def test_events_without_user_count_and_have_no_session(spark):
    e = _events(spark, [(T(2024, 1, 1, 9), 1, "view", "a"), (T(2024, 1, 1, 9, 10), None, "view", "a"), (T(2024, 1, 1, 9, 20), None, "click", "a")])
    r = rows(ev.daily_metrics(e))[0]
    assert (r["events"], r["pageviews"], r["visitors"], r["sessions"], r["bounces"]) == (3, 2, 1, 1, 1)
    assert [r["mau"] for r in rows(ev.monthly_active_users(e))] == [1]
    got = {r["label"]: r for r in rows(ev.range_metrics(e, dt.date(2024, 1, 1), [("today", 0, 0)]))}["today"]
    assert (got["events"], got["visitors"], got["sessions"]) == (3, 1, 1)


def test_sessions_of_users_on_several_sites(spark):
    e = _events(spark, [(T(2024, 1, 1, 9), 1, "view", "a"), (T(2024, 1, 1, 9, 10), 1, "view", "b"), (T(2024, 1, 1, 9, 20), 1, "view", "a"),
                        (T(2024, 1, 1, 23, 50), 2, "view", "b"), (T(2024, 1, 2, 0, 10), 2, "view", "b")])
    got = {(r["site"], str(r["date"])): (r["sessions"], r["bounces"]) for r in rows(ev.daily_metrics(e, by=["site"]))}
    assert got == {("a", "2024-01-01"): (1, 0), ("b", "2024-01-01"): (2, 1), ("b", "2024-01-02"): (0, 0)}


@pytest.mark.parametrize("gap", [1, 7, 30, 1440, 3000])
def test_sessions_match_brute_force_for_any_gap(spark, gap):
    recs = [(T(2024, 1, 1) + dt.timedelta(seconds=(i * 7919 * 13) % 432000), i % 4, "view", "a") for i in range(160)]
    want: dict = {}
    for u in range(4):
        prev = None
        for t in sorted(t for t, v, _, _ in recs if v == u):
            if prev is None or t > prev + dt.timedelta(minutes=gap):
                want[t.date()] = want.get(t.date(), 0) + 1
            prev = t
    got = {r["date"]: r["sessions"] for r in rows(ev.daily_metrics(_events(spark, recs), gap_minutes=gap))}
    assert {k: v for k, v in got.items() if v} == want


def test_reports_scan_events_once(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/events.parquet")
    for df in (ev.daily_metrics(e), ev.monthly_active_users(e)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join" not in plan


def test_bad_cells_never_end_the_scan(spark):
    raw = spark.createDataFrame([("2026-13-45", "99999999999999999999", "x"), ("2026-01-02", "7", "1,5")], "date string, ga_visitors string, ga_bounce_rate string")
    zero = [tuple(r)[:3] for r in typed_from_text(raw, DAILY_SCHEMA).select("date", "ga_visitors", "ga_bounce_rate").collect()]
    assert zero == [(None, 0, 0.0), (dt.date(2026, 1, 2), 7, 1.5)]
    null = typed_from_text(raw, DAILY_SCHEMA, "null").select("ga_visitors").collect()
    assert [r.ga_visitors for r in null] == [None, 7]


def test_text_of_computed_values(spark):
    docs = [('{"type":"formula","formula":{"type":"string","string":"abc"}}', '{"type":"string","string":"abc"}'),
            ('{"type":"rollup","rollup":{"type":"number","number":2.5}}', "2.5"),
            ('{"type":"rollup","rollup":{"type":"date","date":{"start":"2024-01-01"}}}', '{"type":"date","date":{"start":"2024-01-01"}}')]
    df = spark.createDataFrame(docs, "doc string, want string").select("want", F.from_json("doc", PROPERTY_TYPE).alias("p"))
    assert all(r.got == r.want for r in df.select("want", prop_text("p").alias("got")).collect())
