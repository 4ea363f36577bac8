import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import leads, targets
from kpiforge.schemas import LEADS_SCHEMA, TARGETS_SCHEMA
from tests.conftest import rows
from tests.test_rollup_windows import daily

D = dt.date


def lead_frame(spark, recs):
    return spark.createDataFrame(
        [(str(i), f"Co {i}", st, status, 100.0 * i, c, None) + (i,) for i, (st, status, c) in enumerate(recs)],
        LEADS_SCHEMA.simpleString()[:-1] + ",lead_id:bigint>")


def test_status_counts_absent_zero(spark):
    lf = lead_frame(spark, [("s", "new", D(2026, 1, 1)), ("s", "new", D(2026, 1, 2)), ("s", "won", None)])
    r = rows(leads.status_counts(lf))[0]
    assert r == {"total": 3, "new": 2, "active": 0, "won": 1, "lost": 0, "waiting": 0}


def test_funnel_and_fallback(spark):
    lf = lead_frame(spark, [("s", "new", None), ("s", "active", None), ("s", "active", None), ("s", "lost", None)])
    out = rows(leads.lead_funnel(lf), ["pos"])
    assert [(r["stage"], r["value"]) for r in out] == [
        ("Gesamt", 4), ("Aktiv", 2), ("Aktiv (Neu)", 1), ("Warteschleife", 0), ("Gewonnen", 0), ("Verloren", 1)]
    assert out[1]["pct_of_first"] == pytest.approx(50.0)
    d = daily(spark, [{"date": D(2026, 1, 1), "zoho_deals_total": 30}, {"date": D(2026, 1, 2), "zoho_deals_total": 0}])
    fb = rows(leads.lead_funnel(None, d), ["pos"])
    assert [r["value"] for r in fb] == [30, 0, 0, 0, 0, 0]


def test_lists_counts_and_newest(spark):
    lf = lead_frame(spark, [("s", "new", D(2026, 1, 5)), ("s", "active", D(2025, 1, 1)),
                            ("s", "new", D(2026, 1, 5)), ("s", "won", D(2026, 1, 9))])
    ll = rows(leads.lead_lists(lf), ["status", "Name"])
    assert [(r["status"], r["Name"], r["list_size"]) for r in ll] == [("active", "1", 1), ("new", "0", 2), ("new", "2", 2)]
    top = rows(leads.newest_leads(lf, 2))
    assert sorted(r["lead_id"] for r in top) == [0, 3]   # newest, tie at 2026-01-05 broken by key


def test_won_stage_counts_with_range(spark):
    lf = lead_frame(spark, [("Abgeschlossen, gewonnen", "won", D(2026, 1, 1)),
                            ("Abgeschlossen, gewonnen", "won", D(2026, 2, 1)),
                            ("Abgewickelt, -> OPS", "won", D(2026, 1, 15)),
                            ("Warteschleife", "waiting", D(2026, 1, 2))])
    out = {r["stage"]: r["deals"] for r in rows(leads.won_stage_counts(lf, created_from="2026-01-01",
                                                                         created_to="2026-01-31"))}
    assert out == {"Abgeschlossen, gewonnen": 1, "Abgewickelt, -> OPS": 1, None: 2}


def test_ytd_kinds_and_lead_count(spark):
    d = daily(spark, [
        {"date": D(2025, 12, 31), "ga_visitors": 100, "notion_customers_total": 9},
        {"date": D(2026, 1, 1), "ga_visitors": 5, "notion_customers_total": 7},
        {"date": D(2026, 3, 1), "ga_visitors": 6, "notion_customers_total": 0},
    ])
    lf = lead_frame(spark, [("s", "won", None)] * 4)
    out = {r["kpi"]: (r["kind"], r["ytd"]) for r in rows(targets.ytd_values(
        d, lf, 2026, ["ga_visitors", "notion_customers_total", "zoho_deals_new", "zoho_deals_total"]))}
    assert out == {"ga_visitors": ("sum", 11.0), "notion_customers_total": ("snapshot", 7.0),
                   "zoho_deals_new": ("lead_count", 4.0), "zoho_deals_total": ("snapshot", 0.0)}
    empty = rows(targets.ytd_values(d, None, 2030, ["ga_visitors"]))
    assert empty == [{"kpi": "ga_visitors", "kind": "sum", "ytd": 0.0}]


def test_scoreboard_first_target_wins_and_skips_missing(spark):
    d = daily(spark, [{"date": D(2026, 1, 1), "ga_visitors": 50, "li_views": 1}])
    t = spark.createDataFrame([(1, "ga_visitors", 100.0, "B", "W"), (2, "ga_visitors", 1.0, "B", "W"),
                               (3, "li_views", None, "V", "S")], "row_pos int, " + TARGETS_SCHEMA.simpleString()[7:-1])
    out = {r["kpi"]: r for r in rows(targets.target_scoreboard(d, None, t, D(2026, 7, 1)))}
    assert set(out) == {"ga_visitors", "li_views"}
    g = out["ga_visitors"]
    assert g["target"] == 100.0 and g["label"] == "Website Besucher" and g["band"] == "danger"
    assert g["year_progress"] == pytest.approx(182 / 365) and g["status"] == "on_track"
    assert out["li_views"]["status"] == "behind"      # NULL target never counts as met (Q16)


def test_month_vs_target_mapping(spark):
    m = spark.createDataFrame([("2026-01", 120, 7)], "month string, ga_visitors_sum bigint, zoho_deals_new_end bigint")
    t = spark.createDataFrame([("ga_visitors", 1200.0), ("zoho_deals_new", 24.0), ("li_views", 12.0)],
                              "kpi string, target_yearly double").withColumn("row_pos", F.lit(1))
    out = {r["kpi"]: (r["actual"], r["target_month"]) for r in rows(targets.month_vs_target(m, t))}
    assert out == {"ga_visitors": (120.0, 100.0), "zoho_deals_new": (7.0, 2.0)}   # li_views: no column -> no rows
