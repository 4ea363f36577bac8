from kpiforge.operators.rollup import monthly_rollup
from kpiforge.plans import base
from kpiforge.session import scratch_path
from kpiforge.streaming import refresh


def test_stream_equals_batch_and_replay_is_harmless(spark, sf_small):
    root = scratch_path(spark, "stream-test")
    d = base.daily_from_orders(spark, sf_small)
    landing = f"{root}/landing"
    d.repartition(4, "date").write.parquet(landing)
    q = refresh.start_refresh(spark, landing, f"{root}/facts", f"{root}/monthly", f"{root}/ckpt", max_files=2)
    q.awaitTermination()
    got = sorted(tuple(r) for r in refresh.read_monthly(spark, f"{root}/monthly").collect())
    want = sorted(tuple(r) for r in monthly_rollup(d).collect())
    assert got == want
    # the same files landing again (at-least-once replay) change nothing
    d.repartition(2, "date").write.mode("append").parquet(landing)
    q = refresh.start_refresh(spark, landing, f"{root}/facts", f"{root}/monthly", f"{root}/ckpt", max_files=2)
    q.awaitTermination()
    again = sorted(tuple(r) for r in refresh.read_monthly(spark, f"{root}/monthly").collect())
    assert again == want


def test_event_windows_watermark_drops_only_too_late_rows(spark):
    import datetime as dt
    import time

    from kpiforge.streaming import events as sev
    root = scratch_path(spark, "stream-events-test")
    landing = f"{root}/landing"

    def land(rows_, name):
        df = spark.createDataFrame(rows_, sev.EVENTS_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)   # distinct modification times keep arrival order

    t = dt.datetime
    land([(1, t(2024, 1, 1, 10), 1, "view", 1.0, None), (2, t(2024, 1, 1, 11), 2, "purchase", 2.5, None)], "a")
    land([(3, t(2024, 1, 3, 9), 1, "view", 1.0, None)], "b")
    land([(5, t(2024, 1, 3, 10), 2, "purchase", 1.25, None)], "c")
    # 2 days late, after the watermark (max seen - 1 day) has passed the day's end: dropped
    land([(4, t(2024, 1, 1, 12), 3, "view", 1.0, None)], "d")
    q = sev.start_event_windows(spark, landing, f"{root}/t", f"{root}/ck", allowed_lateness="1 day", max_files=1)
    q.awaitTermination()
    got = {r.date: (r.events, r.pageviews, r.purchases, r.purchase_value)
           for r in sev.read_daily_events(spark, f"{root}/t").collect()}
    assert got == {dt.date(2024, 1, 1): (2, 1, 1, 2.5), dt.date(2024, 1, 3): (2, 1, 1, 1.25)}


def test_refresh_once_and_backfill_table(spark, sf_small):
    from pyspark.sql import functions as F

    from kpiforge.operators.facts import merge_sources
    from kpiforge.schemas import DAILY_SCHEMA
    from kpiforge.streaming import jobs
    from kpiforge.operators.facts import schema_with_month
    root = scratch_path(spark, "jobs-test")
    facts_p, monthly_p = f"{root}/facts", f"{root}/monthly"
    d = base.daily_from_orders(spark, sf_small).drop("seq")
    keep = d.where(F.dayofmonth("date") % 3 != 0)
    src1 = keep.select("date", "ga_visitors", "ga_sessions", "notion_customers_total")
    src2 = keep.select("date", "li_impressions", "li_views", "zoho_deals_total")
    jobs.refresh_once(spark, [src1, src2], facts_p, monthly_p, seq=1)
    facts = spark.read.schema(schema_with_month(DAILY_SCHEMA)).parquet(facts_p).drop("month")
    assert facts.count() == keep.count()
    got = sorted(tuple(r) for r in refresh.read_monthly(spark, monthly_p).collect())
    assert got == sorted(tuple(r) for r in monthly_rollup(facts).collect())

    history = d.select("date", (F.col("ga_visitors") + 1000).alias("ga_visitors"))
    touched = jobs.backfill_table(spark, facts_p, monthly_p, history, seq=2)
    assert touched.count() > 0
    facts2 = spark.read.schema(schema_with_month(DAILY_SCHEMA)).parquet(facts_p).drop("month")
    assert facts2.count() == d.count()                                   # every day present once
    unchanged = facts2.join(keep.select("date"), "date", "left_semi")
    assert sorted(tuple(r) for r in unchanged.collect()) == sorted(tuple(r) for r in facts.collect())
    added = facts2.join(keep.select("date"), "date", "left_anti")
    assert added.where(F.col("notion_customers_total") != 0).count() == 0   # other KPIs default to 0
    got2 = sorted(tuple(r) for r in refresh.read_monthly(spark, monthly_p).collect())
    assert got2 == sorted(tuple(r) for r in monthly_rollup(facts2).collect())
