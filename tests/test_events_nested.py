import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from kpiforge.operators import nested as nested_ops
from kpiforge.sources import events as ev
from kpiforge.sources import landed
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, 0, 0)


def _events(spark, recs):
    data = [(i, T0 + dt.timedelta(minutes=m), u, k, 1.0) for i, (m, u, k) in enumerate(recs)]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def _brute_daily(recs, gap=30):
    df = pd.DataFrame([(i, T0 + dt.timedelta(minutes=m), u, k) for i, (m, u, k) in enumerate(recs)],
                      columns=["event_id", "ts", "user_id", "event_type"]).sort_values(["user_id", "ts", "event_id"])
    g = df.groupby("user_id")
    prev, nxt = g["ts"].shift(1), g["ts"].shift(-1)
    lim = pd.Timedelta(minutes=gap)
    df["s"] = prev.isna() | (df["ts"] - prev > lim)
    df["e"] = nxt.isna() | (nxt - df["ts"] > lim)
    df["date"] = df["ts"].dt.date
    out = {}
    for d, x in df.groupby("date"):
        out[d] = (x["user_id"].nunique(), int(x["s"].sum()), int((x["s"] & x["e"]).sum()),
                  int((x["event_type"] == "view").sum()), len(x))
    return out


def test_sessions_across_bucket_edges(spark):
    recs = [(50, 1, "view"), (70, 1, "click"), (105, 1, "view"), (180, 1, "view"), (200, 1, "view"),
            (100, 2, "view"), (1430, 3, "view"), (1455, 3, "view")]   # user 3 crosses midnight within 25 min
    got = {r["date"]: (r["visitors"], r["sessions"], r["bounces"], r["pageviews"], r["events"])
           for r in rows(ev.daily_metrics(_events(spark, recs)))}
    assert got == _brute_daily(recs)


def test_sessions_random_against_brute_force(spark):
    rnd = random.Random(7)
    recs = [(rnd.randint(0, 3 * 1440), rnd.choice([1, 2, 3, 4, 5, 5, 5, 5]), rnd.choice(["view", "click"]))
            for _ in range(400)]
    recs = list({(m, u): (m, u, k) for m, u, k in recs}.values())   # unique (time, user)
    got = {r["date"]: (r["visitors"], r["sessions"], r["bounces"], r["pageviews"], r["events"])
           for r in rows(ev.daily_metrics(_events(spark, recs)))}
    assert got == _brute_daily(recs)


def test_mau_against_brute_force(spark):
    rnd = random.Random(3)
    recs = [(rnd.randint(0, 80) * 1440 + 5, rnd.randint(1, 12), "view") for _ in range(120)]
    df = _events(spark, recs)
    got = {r["date"]: r["mau"] for r in rows(ev.monthly_active_users(df))}
    days = {(T0 + dt.timedelta(minutes=m)).date() for m, _u, _k in recs}
    active = {(u, (T0 + dt.timedelta(minutes=m)).date()) for m, u, _k in recs}
    lo, hi = min(days), max(days)
    expected = {}
    d = lo
    while d <= hi:
        expected[d] = len({u for u, a in active if d - dt.timedelta(days=29) <= a <= d})
        d += dt.timedelta(days=1)
    assert got == expected


def test_range_metrics_empty_range_reports_zero(spark):
    recs = [(10, 1, "view"), (1450, 2, "view")]
    out = {r["label"]: r for r in rows(ev.range_metrics(_events(spark, recs), dt.date(2024, 1, 3),
                                                         [("today", 0, 0), ("yesterday", 1, 1), ("last_7", 7, 1)]))}
    assert out["today"]["visitors"] == 0 and out["today"]["bounce_rate"] == 0.0
    assert out["yesterday"]["visitors"] == 1 and out["last_7"]["visitors"] == 2 and out["last_7"]["sessions"] == 2
    mau = spark.range(1).select(ev.active_users_on(_events(spark, recs), dt.date(2024, 1, 2)).alias("m")).first().m
    assert mau == 2


def test_crm_pages_and_count(spark):
    docs = spark.createDataFrame([
        ('{"data":[{"Deal_Name":"a","Account_Name":{"name":"ACME"},"Amount":1.5,"Pipeline":"Energie"},'
         '{"Deal_Name":"b","Account_Name":"Plain","Amount":2.0,"Pipeline":"Other"}],"info":{"more_records":true}}',),
        ('{"data":[{"Deal_Name":"c","Pipeline":"Energie"}],"info":{"more_records":false}}',),
    ], "doc string")
    pages = landed.parse_landed(docs, "doc", landed.CRM_PAGE_SCHEMA)
    recs = landed.crm_records(pages)
    from kpiforge.functions import name_of
    names = sorted(r.n for r in recs.select(name_of("Account_Name").alias("n")).collect())
    assert names == ["", "ACME", "Plain"]
    assert rows(landed.crm_record_count(pages)) == [{"records": 3, "pages": 2}]


def test_stats_elements_defaults_and_interval(spark):
    docs = spark.createDataFrame([
        ('{"elements":[{"totalShareStatistics":{"impressionCount":5,"clickCount":2,"engagement":0.5},'
         '"pageStatistics":{"views":{"allPageViews":{"pageViews":3}}}},{"totalShareStatistics":{}}],'
         '"timeRange":{"start":1000,"end":2000}}',),
        ('{"elements":[],"timeRange":{"start":5000,"end":6000}}',),
    ], "doc string")
    d = landed.parse_landed(docs, "doc", landed.STATS_SCHEMA)
    inside = landed.stats_in_interval(d, 1000, 2000)
    assert rows(nested_ops.element_totals(inside)) == [{"impressions": 5, "views": 5.5}]


def test_first_data_source_and_picklists(spark):
    cats = spark.createDataFrame([
        ('{"data_sources":[{"id":"","data_source_id":""},{"id":"x2"}]}',),
        ('{"data_sources":[]}',),
        ('{"data_sources":[{"data_source_id":"d1"},{"id":"x"}]}',),
    ], "doc string")
    out = [r.first_id for r in landed.first_data_source_id(landed.parse_landed(cats, "doc", landed.CATALOG_SCHEMA))
           .collect()]
    assert out == ["x2", None, "d1"]
    f = spark.createDataFrame([('{"fields":[{"api_name":"Stage","data_type":"picklist","pick_list_values":'
                                '[{"display_value":"A","actual_value":"a"},{"display_value":"B","actual_value":"b"}]},'
                                '{"api_name":"Amount","data_type":"currency"}]}',)], "doc string")
    pv = landed.picklist_values(landed.parse_landed(f, "doc", landed.FIELDS_SCHEMA), ["Stage"])
    assert [r.actual_value for r in pv.collect()] == ["a", "b"]


def test_approx_mau_close_to_exact(spark):
    rnd = random.Random(11)
    recs = [(rnd.randint(0, 60) * 1440 + rnd.randint(0, 1000), rnd.randint(1, 3000), "view") for _ in range(20000)]
    df = _events(spark, recs)
    exact = {r["date"]: r["mau"] for r in rows(ev.monthly_active_users(df))}
    approx = {r["date"]: r["mau_approx"] for r in rows(ev.approx_monthly_active_users(df))}
    assert set(exact) == set(approx)
    for d, v in exact.items():
        assert abs(approx[d] - v) <= max(5, 0.05 * v), (d, v, approx[d])


def test_hot_user_third_of_events(spark):
    # one user holds a third of all events, spread over many hour buckets
    rnd = random.Random(5)
    recs = []
    for _ in range(900):
        recs.append((rnd.randint(0, 4 * 1440), 1, rnd.choice(["view", "click"])))
    for _ in range(1800):
        recs.append((rnd.randint(0, 4 * 1440), rnd.randint(2, 60), rnd.choice(["view", "click"])))
    recs = list({(m, u): (m, u, k) for m, u, k in recs}.values())
    df = _events(spark, recs)
    got = {r["date"]: (r["visitors"], r["sessions"], r["bounces"], r["pageviews"], r["events"])
           for r in rows(ev.daily_metrics(df))}
    assert got == _brute_daily(recs)
    exact = {r["date"]: r["mau"] for r in rows(ev.monthly_active_users(df))}
    assert max(exact.values()) == len({u for _m, u, _k in recs})
