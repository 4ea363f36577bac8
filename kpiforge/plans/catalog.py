"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables (or frames Spark derives from them) and
composes library operators; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from ..functions.nested import PAGE_RESPONSE_SCHEMA, PROPERTY_TYPE
from ..functions.numbers import exact_sum
from ..operators import bucketed, facts, reports, rollup, sketches, targets, windows
from ..operators import leads as leads_ops
from ..operators import nested as nested_ops
from ..schemas import DAILY_KPIS, DAILY_SCHEMA, LEADS_SCHEMA, WON_STAGES
from ..session import ensure_runtime_conf, scratch_path
from ..sources import events as ev
from ..sources import chains, footers, landed, tables
from ..streaming import events as sev
from ..streaming import leads as sl
from ..streaming import refresh
from ..streaming import sessions as ss
from . import base, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_runtime_conf(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return run
    return deco


@register("monthly_rollup")
def q_monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1..6, WIN-5, FLT-3/4, SCL-4, ORD-1."""
    return rollup.monthly_rollup(base.daily_from_orders(spark, sf_dir))


# --- rollup variant, windows, series -------------------------------------------------


# Series labels of the traffic chart.
TRAFFIC_LABELS = {"ga_visitors": "Besucher", "ga_sessions": "Sessions"}
TRAILING_COLS = ["date", "ga_visitors", "ga_sessions", "ga_bounce_rate", "zoho_deals_total", "li_impressions",
                 "auth0_mau", "notion_yearly_consumption_gwh"]


@register("monthly_rollup_variant")
def q_monthly_rollup_variant(spark, sf_dir):
    """AGG-7, WIN-6."""
    return rollup.monthly_rollup_variant(base.daily_from_orders(spark, sf_dir))


@register("period_sum_delta")
def q_period_sum_delta(spark, sf_dir):
    """WIN-1, WIN-2, ORD-3, SCL-13."""
    return windows.period_sum_delta(base.daily_from_orders(spark, sf_dir), ["ga_visitors", "li_impressions"])


@register("trailing_sum_series")
def q_trailing_sum_series(spark, sf_dir):
    """WIN-1/2 series form."""
    return windows.trailing_sum_series(base.daily_from_orders(spark, sf_dir), "ga_visitors", 7)


@register("offset_delta")
def q_offset_delta(spark, sf_dir):
    """WIN-3."""
    return windows.offset_delta(base.daily_from_orders(spark, sf_dir), "ga_visitors", 7)


@register("last_known_delta")
def q_last_known_delta(spark, sf_dir):
    """WIN-4, AGG-3, FLT-4."""
    return windows.last_known_delta(base.daily_from_orders(spark, sf_dir), "notion_customers_total")


@register("trailing_range")
def q_trailing_range(spark, sf_dir):
    """FLT-1, AGG-13, RPT-7, RPT-8."""
    return windows.trailing_range(base.daily_from_orders(spark, sf_dir), 30, cols=TRAILING_COLS)


@register("series_long")
def q_series_long(spark, sf_dir):
    """RPT-1."""
    return reports.series_long(base.daily_from_orders(spark, sf_dir), "date", ["ga_visitors", "ga_sessions"],
                               TRAFFIC_LABELS)


@register("kpi_cards")
def q_kpi_cards(spark, sf_dir):
    """RPT-2, PRJ-6."""
    return reports.kpi_cards(base.daily_from_orders(spark, sf_dir), base.leads_from_orders(spark, sf_dir), 30)


# --- leads ----------------------------------------------------------------------------

@register("lead_status")
def q_lead_status(spark, sf_dir):
    """FLT-6, FLT-8, SCL-9, SCL-18."""
    return base.leads_from_orders(spark, sf_dir)


@register("lead_status_counts")
def q_lead_status_counts(spark, sf_dir):
    """AGG-8, AGG-9."""
    return leads_ops.status_counts(base.leads_from_orders(spark, sf_dir))


@register("lead_funnel")
def q_lead_funnel(spark, sf_dir):
    """RPT-3, WIN-8."""
    return leads_ops.lead_funnel(base.leads_from_orders(spark, sf_dir))


@register("lead_lists")
def q_lead_lists(spark, sf_dir):
    """RPT-4, PRJ-1, FLT-5: from the persisted lead snapshot, as lists and sizes both read it."""
    path = scratch_path(spark, "leads")
    facts.write_snapshot(base.leads_from_orders(spark, sf_dir), path)
    return leads_ops.lead_lists(spark.read.parquet(path))


@register("won_stage_counts")
def q_won_stage_counts(spark, sf_dir):
    """AGG-15, FLT-7."""
    return leads_ops.won_stage_counts(base.leads_from_orders(spark, sf_dir), WON_STAGES)


@register("newest_leads")
def q_newest_leads(spark, sf_dir):
    """ORD-4, ORD-5, SCL-11."""
    return leads_ops.newest_leads(base.leads_from_orders(spark, sf_dir), 5)


# --- targets --------------------------------------------------------------------------


@register("ytd_values")
def q_ytd_values(spark, sf_dir):
    """AGG-14, FLT-2."""
    return targets.ytd_values(base.daily_from_orders(spark, sf_dir), base.leads_from_orders(spark, sf_dir),
                              base.YTD_YEAR, DAILY_KPIS)


def _scoreboard(spark, sf_dir):
    return targets.target_scoreboard(base.daily_from_orders(spark, sf_dir), base.leads_from_orders(spark, sf_dir),
                                     base.targets_frame(spark), base.SCOREBOARD_AS_OF)


@register("target_scoreboard")
def q_target_scoreboard(spark, sf_dir):
    """RPT-5, JON-2, JON-6, JON-7, SCL-6, SCL-20, SCL-21, WIN-7."""
    return _scoreboard(spark, sf_dir)


@register("progress_record")
def q_progress_record(spark, sf_dir):
    """SCL-14, SCL-22."""
    return targets.progress_records(_scoreboard(spark, sf_dir))


@register("month_vs_target")
def q_month_vs_target(spark, sf_dir):
    """RPT-6, PRJ-2, PRJ-3, JON-3, SCL-23."""
    monthly = rollup.monthly_rollup(base.daily_from_orders(spark, sf_dir))
    return targets.month_vs_target(monthly, base.targets_frame(spark))


# --- fact maintenance -----------------------------------------------------------------

@register("upsert_daily")
def q_upsert_daily(spark, sf_dir):
    """SNK-1, SNK-4, JON-5, PRJ-4, SET-1, SET-3, STR-2."""
    existing, updates = base.upsert_inputs(base.daily_from_orders(spark, sf_dir))
    return facts.upsert(existing, updates, ["date"], "seq")


@register("backfill_daily")
def q_backfill_daily(spark, sf_dir):
    """SNK-2, JON-4, SET-2, SRC-5."""
    existing, history = base.backfill_inputs(base.daily_from_orders(spark, sf_dir))
    return facts.backfill(existing, history, "date")


@register("merge_sources")
def q_merge_sources(spark, sf_dir):
    """JON-1, PRJ-4."""
    d = base.daily_from_orders(spark, sf_dir).select("date", "ga_visitors", "ga_sessions", "li_views")
    return facts.merge_sources([d, base.lineitem_source(spark, sf_dir)], "date")


# --- scalar functions over driver rows ------------------------------------------------


# format name per o_orderkey % 8
NUMBER_FORMATS = ["en_grouped", "de_grouped", "comma_decimal", "plain", "padded", "currency_suffix",
                  "commas_only", "null"]


def formatted_prices(spark, sf_dir):
    """Order prices written as text in eight locale shapes (SNK-6 style cells)."""
    o = base.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 8
    plain = F.format_string("%.2f", p)
    en = F.format_number(p, 2)
    text = (F.when(k == 0, en)
            .when(k == 1, F.translate(en, ",.", ".,"))
            .when(k == 2, F.regexp_replace(plain, r"\.", ","))
            .when(k == 3, plain)
            .when(k == 4, F.concat(F.lit(" "), plain, F.lit(" ")))
            .when(k == 5, F.concat(plain, F.lit(" €")))
            .when(k == 6, F.format_number(F.floor(p), 0)))
    fmt = F.element_at(F.array(*[F.lit(n) for n in NUMBER_FORMATS]), (k + 1).cast("int"))
    return o.select("o_orderkey", fmt.alias("fmt"), text.alias("text"))


@register("parse_number_locale")
def q_parse_number_locale(spark, sf_dir):
    """SCL-1, UDF-1, SNK-6."""
    t = formatted_prices(spark, sf_dir)
    return t.select("o_orderkey", "fmt", fx.parse_number("text").alias("value"))


@register("coerce_targets")
def q_coerce_targets(spark, sf_dir):
    """SCL-2, SRC-3: plain numeric coercion of target cells (bad -> NULL)."""
    o = base.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    plain = F.format_string("%.2f", p)
    text = (F.when(k == 0, plain).when(k == 1, F.regexp_replace(plain, r"\.", ","))
            .when(k == 2, F.concat(F.lit("  "), plain, F.lit(" "))).otherwise(F.lit("n/a")))
    return o.select(F.concat(F.lit("kpi_"), F.col("o_orderkey").cast("string")).alias("kpi"),
                    fx.coerce_number(text).alias("target_yearly"))


@register("date_keys")
def q_date_keys(spark, sf_dir):
    """SCL-3, SCL-5, SCL-6, SCL-7, SCL-8."""
    d = base.read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return d.select(
        "date",
        fx.yyyymmdd_to_date(F.date_format("date", "yyyyMMdd")).alias("parsed"),
        fx.month_key("date").alias("month"),
        fx.days_before(F.col("date"), 1).alias("yesterday"),
        fx.days_before(F.col("date"), 14).alias("cutoff_14d"),
        F.year("date").alias("year"),
        F.dayofyear("date").alias("day_of_year"),
        fx.days_in_year("date").alias("days_in_year"),
        fx.year_progress("date").alias("year_progress"),
        fx.day_start_ms("date").alias("day_start_ms"),
        fx.day_end_ms("date").alias("day_end_ms"),
        fx.weekend_factor("date").alias("weekend_factor"),
    )


# --- event reports ---------------------------------------------------------------------

@register("metric_report_daily")
def q_metric_report_daily(spark, sf_dir):
    """SRC-11, SCL-13, ORD-2."""
    return ev.daily_metrics(base.read(spark, sf_dir, "events")).orderBy("date")


@register("metric_report_ranges")
def q_metric_report_ranges(spark, sf_dir):
    """SRC-10, SRC-12."""
    return ev.range_metrics(base.read(spark, sf_dir, "events"), ev.EVENTS_AS_OF, ev.DEFAULT_RANGES)


@register("monthly_active_users")
def q_monthly_active_users(spark, sf_dir):
    """SRC-14."""
    return ev.monthly_active_users(base.read(spark, sf_dir, "events"))


# --- landed documents ------------------------------------------------------------------


_DEC = "decimal(38,9)"


#: Documents of one landed file. A compressed file is read by one task, so its size has a bound.
LANDED_DOCS = 10_000


def _read_pages(spark, docs, name, schema):
    """Land the documents once, a JSON line each in compressed files, and read the folder as the library does."""
    path = scratch_path(spark, name)
    docs.select("doc").write.option("maxRecordsPerFile", LANDED_DOCS).text(path, compression="snappy")
    return landed.read_landed(spark, path, schema, multiline=False)


@register("paged_json_scan")
def q_paged_json_scan(spark, sf_dir):
    """SRC-6, SRC-7, SRC-8, SET-1, PRJ-5, SCL-18: CRM pages -> records, per
    pipeline plus an all-pages row counted without exploding."""
    pages = _read_pages(spark, documents.crm_pages(spark, sf_dir), "crm", landed.CRM_PAGE_SCHEMA)
    recs = landed.crm_records(pages).select(F.col("Pipeline").alias("pipeline"), "Amount",
                                            fx.name_of("Account_Name").alias("company"))
    per = recs.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_records"), exact_sum("Amount", 2).alias("amount"),
                                       F.count_distinct("company").alias("n_companies"))
    page_amount = F.aggregate("data", F.lit(0).cast(_DEC), lambda acc, r: (acc + r["Amount"].cast(_DEC)).cast(_DEC))
    total = pages.agg(F.sum(F.size("data")).cast("bigint").alias("n_records"),
                      F.round(F.sum(page_amount), 2).cast("double").alias("amount"))
    n_comp = recs.agg(F.count_distinct("company").alias("n")).select("n").scalar()
    return per.unionByName(total.select(F.lit("*").alias("pipeline"), "n_records", "amount",
                                        n_comp.alias("n_companies")))


def _lineitem_pages(spark, sf_dir):
    resp = _read_pages(spark, documents.lineitem_page_responses(spark, sf_dir), "pages", PAGE_RESPONSE_SCHEMA)
    return landed.page_results(resp)


@register("nested_property_sum")
def q_nested_property_sum(spark, sf_dir):
    """AGG-10, SCL-15, SCL-16, SCL-17, SCL-19."""
    pages = _lineitem_pages(spark, sf_dir)
    status = F.col("properties").getItem("Status").getField("select").getField("name").alias("status")
    t = nested_ops.positive_property_totals(pages, documents.KWH_NAMES, documents.PROVISION_NAME, by=[status])
    return t.select("status", "n_pages", "value_pages", F.col("total_converted").alias("total_gwh"),
                    F.col("formula_total").alias("provision"))


@register("nested_array_sum")
def q_nested_array_sum(spark, sf_dir):
    """AGG-11, SRC-13."""
    docs = landed.parse_landed(documents.social_stat_docs(spark, sf_dir), "doc", landed.STATS_SCHEMA)
    day = fx.date_of_ms(F.col("timeRange.start")).alias("date")
    return nested_ops.element_totals(docs, by=[day])


@register("distinct_customers_nested")
def q_distinct_customers_nested(spark, sf_dir):
    """AGG-12, SET-4."""
    resp = landed.parse_landed(documents.order_customer_responses(spark, sf_dir), "doc", PAGE_RESPONSE_SCHEMA)
    pages = landed.page_results(resp)
    status = F.col("properties").getItem("Status").getField("select").getField("name").alias("status")
    return nested_ops.distinct_identities(pages, documents.CUSTOMER_NAMES, by=[status], value_candidates=["kWh"])


@register("property_inventory")
def q_property_inventory(spark, sf_dir):
    """SRC-17."""
    return landed.property_inventory(_lineitem_pages(spark, sf_dir))


@register("first_data_source")
def q_first_data_source(spark, sf_dir):
    """SRC-9."""
    cats = landed.parse_landed(documents.part_catalogs(spark, sf_dir), "doc", landed.CATALOG_SCHEMA)
    return landed.first_data_source_id(cats, keep=["id"])


# --- sinks, streaming, health, generator ---------------------------------------------


@register("snapshot_overwrite")
def q_snapshot_overwrite(spark, sf_dir):
    """SNK-3, SNK-5, SNK-6, SRC-1, SRC-2, SRC-4: the lead snapshot is written
    as text cells, replaced by a second snapshot, and read back typed."""
    path = scratch_path(spark, "leads_snapshot")
    leads = base.leads_from_orders(spark, sf_dir).select(*LEADS_SCHEMA.fieldNames())
    facts.write_snapshot(leads.where(F.col("status") == "won"), path, LEADS_SCHEMA, fmt="csv")
    facts.write_snapshot(leads, path, LEADS_SCHEMA, fmt="csv")
    return facts.read_snapshot(spark, path, LEADS_SCHEMA, fmt="csv")


@register("stream_refresh")
def q_stream_refresh(spark, sf_dir):
    """STR-1, STR-3: daily fact files as a stream, upserted per micro-batch,
    touched months recomputed; returns the resulting monthly table."""
    root = scratch_path(spark, "stream_refresh")
    landing, facts_p, monthly_p, ckpt = (f"{root}/landing", f"{root}/facts", f"{root}/monthly", f"{root}/ckpt")
    # landed in date ranges, as daily files arrive; a later batch then touches only later months
    base.daily_from_orders(spark, sf_dir).repartitionByRange("date").write.mode("overwrite").parquet(landing)
    q = refresh.start_refresh(spark, landing, facts_p, monthly_p, ckpt, max_files=8)
    q.awaitTermination()
    return refresh.read_monthly(spark, monthly_p)


@register("load_health")
def q_load_health(spark, sf_dir):
    """AGG-16: expected tables, presence and row counts."""
    path = scratch_path(spark, "kpi_daily")
    base.daily_from_orders(spark, sf_dir).write.parquet(path)       # counts are of persisted tables
    d = spark.read.parquet(path)
    frames = {"kpi_daily": d, "kpi_monthly": rollup.monthly_rollup(d), "kpi_targets": base.targets_frame(spark),
              "zoho_leads": base.leads_from_orders(spark, sf_dir), "kpi_events": None}
    return reports.table_counts(frames, ["kpi_daily", "kpi_monthly", "kpi_targets", "zoho_leads", "kpi_events"])


@register("tenant_monthly_rollup")
def q_tenant_monthly_rollup(spark, sf_dir):
    """AGG-6 + WIN-5 with grouping keys: the monthly rollup of daily facts of
    every customer as a tenant (windows partitioned by tenant)."""
    return rollup.monthly_rollup(base.daily_from_orders(spark, sf_dir, tenants=True), by=["tenant"])


@register("tenant_ytd_values")
def q_tenant_ytd_values(spark, sf_dir):
    """AGG-14 with grouping keys: customers without orders in the year get 0."""
    daily = base.daily_from_orders(spark, sf_dir, tenants=True)
    return targets.ytd_values(daily, None, base.YTD_YEAR, ["ga_visitors", "notion_customers_total", "notion_provision_eur"], by=["tenant"])


@register("tenant_stream_refresh")
def q_tenant_stream_refresh(spark, sf_dir):
    """STR-1, STR-3, SNK-1 with grouping keys: the refresh stream over the daily
    facts of every customer as a tenant; returns the monthly table."""
    root = scratch_path(spark, "tenant_refresh")
    landing, facts_p, monthly_p, ckpt = (f"{root}/landing", f"{root}/facts", f"{root}/monthly", f"{root}/ckpt")
    daily = base.daily_from_orders(spark, sf_dir, tenants=True)
    daily.repartitionByRange("date").write.parquet(landing)
    q = refresh.start_refresh(spark, landing, facts_p, monthly_p, ckpt, daily.schema, max_files=8, by=["tenant"])
    q.awaitTermination()
    return refresh.read_monthly(spark, monthly_p, daily.schema, ["tenant"])


@register("upsert_replay")
def q_upsert_replay(spark, sf_dir):
    """STR-2, SNK-1: a batch with NULL values written twice; the second write changes nothing."""
    path = f"{scratch_path(spark, 'upsert_replay')}/facts"
    _, updates = base.upsert_inputs(base.daily_from_orders(spark, sf_dir))
    for _ in range(2):
        facts.upsert_table(spark, path, updates, schema=DAILY_SCHEMA)
    return spark.read.schema(facts.schema_with_month(DAILY_SCHEMA)).parquet(path)


@register("stream_event_windows")
def q_stream_event_windows(spark, sf_dir):
    """STR-1, STR-3, SRC-11 streaming form: event files as a stream, one-day
    tumbling windows in update mode, upserted by date per micro-batch."""
    root = scratch_path(spark, "stream_events")
    landing, table, ckpt = f"{root}/landing", f"{root}/daily_events", f"{root}/ckpt"
    base.read(spark, sf_dir, "events").write.mode("overwrite").parquet(landing)   # files as the input's splits
    q = sev.start_event_windows(spark, landing, table, ckpt, max_files=64)
    q.awaitTermination()
    return sev.read_daily_events(spark, table)


@register("tenant_upsert")
def q_tenant_upsert(spark, sf_dir):
    """SNK-1, JON-5, SET-3, PRJ-4 with composite keys: keyed upsert of daily
    facts of every customer as a tenant."""
    existing, updates = base.tenant_upsert_inputs(base.daily_from_orders(spark, sf_dir, tenants=True))
    return facts.upsert(existing, updates, ["tenant", "date"], "seq")


# --- text tables, reports without a query of their own --------------------------------

def _landed_text(spark, df, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@register("load_daily_text")
def q_load_daily_text(spark, sf_dir):
    """SRC-1, SNK-6, UDF-1: daily facts landed as text, with planted bad cells."""
    text = base.daily_text(base.daily_from_orders(spark, sf_dir))
    return tables.load_daily(spark, _landed_text(spark, text, "daily_text"))


@register("load_monthly_text")
def q_load_monthly_text(spark, sf_dir):
    """SRC-2, SNK-6: monthly facts landed as text."""
    text = base.as_text(rollup.monthly_rollup(base.daily_from_orders(spark, sf_dir)))
    return tables.load_monthly(spark, _landed_text(spark, text, "monthly_text"))


@register("load_targets_text")
def q_load_targets_text(spark, sf_dir):
    """SRC-3, SCL-2, SCL-10: a target per part as text (padded key; decimal
    comma and words are bad), with its order column; first target per brand."""
    p = base.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = F.format_string("%.2f", "p_retailprice")
    value = F.when(k % 5 == 0, F.regexp_replace(price, r"\.", ",")).when(k % 7 == 0, F.lit("offen")).otherwise(price)
    text = p.select(k.alias("row_pos"), F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("kpi"), value.alias("target_yearly"),
                    F.lit("EUR").alias("unit"), F.col("p_type").alias("category"))
    t = tables.load_targets(spark, _landed_text(spark, base.as_text(text), "targets_text"))
    return targets.first_targets(t.withColumn("kpi", fx.clean_key("kpi")))


@register("metric_report_by_kind")
def q_metric_report_by_kind(spark, sf_dir):
    """SRC-11 with grouping keys: sessions per event type; users visit several groups."""
    return ev.daily_metrics(base.read(spark, sf_dir, "events"), by=["event_type"])


@register("bounce_from_engagement")
def q_bounce_from_engagement(spark, sf_dir):
    """SRC-12: bounce rate, from the engagement rate on days whose bounce rate is missing."""
    m = ev.daily_metrics(base.read(spark, sf_dir, "events"))
    given = F.when(F.dayofmonth("date") % 2 == 0, F.col("bounce_rate"))
    engaged = F.lit(100.0) - F.col("bounce_rate")
    return m.select("date", given.alias("bounce"), fx.bounce_with_fallback(given, engaged).alias("bounce_rate"))


@register("active_users_scalar")
def q_active_users_scalar(spark, sf_dir):
    """SRC-14 scalar form: active users on the report day beside each day's visitors."""
    e = base.read(spark, sf_dir, "events")
    return ev.daily_metrics(e).select("date", "visitors", ev.active_users_on(e, ev.EVENTS_AS_OF).alias("mau"))


@register("trailing_series_long")
def q_trailing_series_long(spark, sf_dir):
    """FLT-1 then RPT-1: the chart series over the filtered window."""
    window = windows.trailing_range(base.daily_from_orders(spark, sf_dir), 90, cols=["date", "ga_visitors", "ga_sessions"])
    return reports.series_long(window, "date", ["ga_visitors", "ga_sessions"], TRAFFIC_LABELS)


@register("won_stage_counts_created")
def q_won_stage_counts_created(spark, sf_dir):
    """AGG-15, FLT-7: won deals created in a range of days."""
    return leads_ops.won_stage_counts(base.leads_from_orders(spark, sf_dir), WON_STAGES, "1997-01-01", "1998-06-30")


@register("lead_funnel_without_leads")
def q_lead_funnel_without_leads(spark, sf_dir):
    """RPT-3: the funnel when there is no lead table, from the daily facts."""
    return leads_ops.lead_funnel(None, base.daily_from_orders(spark, sf_dir))


@register("kpis_collected")
def q_kpis_collected(spark, sf_dir):
    """AGG-16: KPIs with a value on each customer's latest day."""
    daily = base.daily_from_orders(spark, sf_dir, tenants=True)
    some = daily.withColumn("li_views", F.when(F.col("li_views") > 0, F.col("li_views")))
    return reports.kpis_collected(some, ["ga_visitors", "li_views", "notion_provision_eur"], by=["tenant"])


@register("gauge_edges")
def q_gauge_edges(spark, sf_dir):
    """SCL-21: attainment and gauge edges of each month against a fixed monthly target."""
    m = rollup.monthly_rollup(base.daily_from_orders(spark, sf_dir))
    target = F.lit(120.0)
    pct = fx.attainment_pct("ga_visitors_sum", target)
    return m.select("month", "ga_visitors_sum", pct.alias("pct"), fx.attainment_band(pct).alias("band"), *fx.gauge_edges(target))


@register("tagged_values")
def q_tagged_values(spark, sf_dir):
    """SCL-16: readable values of properties of all nine tags, of computed ones that are no numbers, and of an unknown tag."""
    t = documents.tagged_pages(spark, sf_dir)
    props = F.from_json("doc", T.MapType(T.StringType(), PROPERTY_TYPE))
    return t.select("o_orderkey", "kind", fx.prop_text(props.getItem("Value")).alias("value"))


@register("stats_interval")
def q_stats_interval(spark, sf_dir):
    """SRC-13, AGG-11: statistics documents of an interval of days."""
    docs = _read_pages(spark, documents.social_stat_docs(spark, sf_dir), "stats", landed.STATS_SCHEMA)
    lo, hi = fx.day_start_ms(F.lit("2024-01-08").cast("date")), fx.day_start_ms(F.lit("2024-01-22").cast("date"))
    inside = landed.stats_in_interval(docs, lo, hi)
    return nested_ops.element_totals(inside, by=[fx.date_of_ms(F.col("timeRange.start")).alias("date")])


@register("picklist_values")
def q_picklist_values(spark, sf_dir):
    """SRC-17: picklist values of wanted fields."""
    docs = _read_pages(spark, documents.picklist_docs(spark, sf_dir), "picklists", landed.FIELDS_SCHEMA)
    return landed.picklist_values(docs, ["Brand#11", "Brand#23", "Brand#45"])


# --- streams with state, landed page chains ---------------------------------------------

def _landed_events(spark, sf_dir, name, streams):
    """Land the events in three turns with late and repeated ones; after each turn the streams take up what is new."""
    root = scratch_path(spark, name)
    for part in base.event_landings(spark, sf_dir):
        part.write.mode("append").parquet(f"{root}/in")
        for start, kind in streams:
            start(spark, f"{root}/in", f"{root}/{kind}", f"{root}/ck-{kind}").awaitTermination()
    return root


@register("stream_sessions")
def q_stream_sessions(spark, sf_dir):
    """SRC-10, SRC-11, STR-1, STR-3: daily metrics of sessions and activity streams over late and repeated files."""
    root = _landed_events(spark, sf_dir, "stream_sessions", [(ss.start_sessions, "sessions"), (ss.start_activity, "activity")])
    return ss.read_daily_metrics(spark, f"{root}/sessions", f"{root}/ck-sessions", f"{root}/activity")


@register("stream_unique_events")
def q_stream_unique_events(spark, sf_dir):
    """STR-3: daily event counts of a stream in which files are late and land twice."""
    root = _landed_events(spark, sf_dir, "stream_unique", [(ss.start_activity, "activity")])
    return ss.read_daily_events(spark, f"{root}/activity")


def _crm_chain(spark, sf_dir):
    pages = _read_pages(spark, documents.landed_crm_pages(spark, sf_dir), "crm_chain", landed.CRM_PAGE_SCHEMA)
    return chains.numbered_chain(pages, F.col("info.page"), F.col("info.more_records"), first=0)


@register("crm_chain_records")
def q_crm_chain_records(spark, sf_dir):
    """SRC-6: records per pipeline of a landing with repeated, missing and trailing pages."""
    kept, _ = _crm_chain(spark, sf_dir)
    return landed.crm_records(kept).groupBy(F.col("Pipeline").alias("pipeline")).agg(
        F.count(F.lit(1)).alias("n_records"), exact_sum("Amount", 2).alias("amount"))


@register("crm_chain_report")
def q_crm_chain_report(spark, sf_dir):
    """SRC-6, SRC-7: what of the landing counts, and the number of its records."""
    kept, report = _crm_chain(spark, sf_dir)
    counted = landed.crm_record_count(kept)
    return report.crossJoin(F.broadcast(counted))          # one row each


@register("crm_missing_pages")
def q_crm_missing_pages(spark, sf_dir):
    """SRC-6: runs of missing pages."""
    pages = _read_pages(spark, documents.landed_crm_pages(spark, sf_dir), "crm_gaps", landed.CRM_PAGE_SCHEMA)
    return chains.missing_pages(pages, F.col("info.page"), F.col("info.more_records"), first=0)


@register("cursor_chain_report")
def q_cursor_chain_report(spark, sf_dir):
    """SRC-8: two fetches of cursor responses, one with strays and repeats, one with breaks; the results that count."""
    pages = _read_pages(spark, documents.landed_page_responses(spark, sf_dir), "cursor_chain", documents.LANDED_RESPONSE_SCHEMA)
    kept, report = chains.cursor_chain(pages, F.col("start_cursor"), F.col("next_cursor"), F.col("has_more"), by=["run"])
    counts = kept.groupBy("run").agg(F.sum(F.size("results")).cast("bigint").alias("results"))
    return report.join(counts, "run")


@register("load_leads_text")
def q_load_leads_text(spark, sf_dir):
    """SRC-4, SNK-6: the lead snapshot landed as text, with planted bad amounts and dates; counts per status and month."""
    leads = base.as_text(base.leads_from_orders(spark, sf_dir))
    k = F.col("lead_id").cast("bigint")
    bad = leads.withColumns({"amount": F.when(k % 11 == 0, F.lit("n/a")).otherwise(F.col("amount")),
                             "closing_date": F.when(k % 13 == 0, F.lit("soon")).otherwise(F.col("closing_date"))}).drop("lead_id")
    got = tables.load_leads(spark, _landed_text(spark, bad, "leads_text"))
    return got.groupBy("status", fx.month_key("closing_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count("amount").alias("with_amount"), exact_sum("amount", 2).alias("amount"))


def _with_late_days(spark, sf_dir, name, tenants):
    """The refresh in two batches: all days but every seventeenth, then those, far behind the rest; the monthly table."""
    root = scratch_path(spark, name)
    daily = base.daily_from_orders(spark, sf_dir, tenants=tenants)
    by = ["tenant"] if tenants else []
    late = F.dayofmonth("date") == 17
    for part in (daily.where(~late), daily.where(late)):
        refresh.refresh_batch(part, f"{root}/facts", f"{root}/monthly", daily.schema, by)
    return refresh.read_monthly(spark, f"{root}/monthly", daily.schema, by)


@register("late_days_rollup")
def q_late_days_rollup(spark, sf_dir):
    """AGG-6, STR-3: late days applied through stored partial aggregates."""
    return _with_late_days(spark, sf_dir, "late_days", False)


@register("tenant_late_days_rollup")
def q_tenant_late_days_rollup(spark, sf_dir):
    """AGG-6, STR-3 with grouping keys: late days of every customer."""
    return _with_late_days(spark, sf_dir, "tenant_late_days", True)


@register("stream_lead_status")
def q_stream_lead_status(spark, sf_dir):
    """AGG-8, AGG-9, FLT-8, STR-1: status counts of a stream of lead changes. Two thirds of the leads are seen open first
    and move to their stage with a later file, every tenth is taken out and comes back, and older changes come late."""
    root = scratch_path(spark, "stream_leads")
    leads = base.leads_from_orders(spark, sf_dir)
    k = F.col("lead_id")

    def change(rows, stage, seq):
        return rows.select("lead_id", F.lit(stage).cast("string").alias("stage") if not isinstance(stage, Column) else stage.alias("stage"),
                           "created_date", F.lit(seq).cast("bigint").alias("seq"))

    landings = [change(leads.where(k % 3 != 0), base.OPEN_STAGE_P, 1),
                change(leads.where(k % 10 == 0), None, 3).unionByName(change(leads.where(k % 10 != 0), F.col("stage"), 2)),
                change(leads.where(k % 10 == 0), F.col("stage"), 4).unionByName(change(leads.where(k % 7 == 0), base.OPEN_STAGE_O, 0))]
    for part in landings:
        part.write.mode("append").parquet(f"{root}/in")
        sl.start_lead_status(spark, f"{root}/in", f"{root}/state", f"{root}/counts", f"{root}/ck").awaitTermination()
    return sl.read_status_counts(spark, f"{root}/counts", base.LEADS_AS_OF)


@register("bucketed_upsert")
def q_bucketed_upsert(spark, sf_dir):
    """SNK-1, JON-5: the upsert of ``tenant_upsert`` on a stored table bucketed by tenant."""
    existing, updates = base.tenant_upsert_inputs(base.daily_from_orders(spark, sf_dir, tenants=True))
    path = scratch_path(spark, "bucketed")
    name = bucketed.fact_table(spark, f"facts_{path.rsplit('-', 1)[1]}", path, existing.schema, ["tenant"], 8)
    first = windows.last_per_key(existing, ["tenant", "date"], "seq")
    bucketed.upsert_bucketed(spark, name, first, ["tenant", "date"])
    bucketed.upsert_bucketed(spark, name, updates, ["tenant", "date"])
    return spark.table(name).drop("month", "bucket")


# --- footers of stored tables ------------------------------------------------------------

@register("source_health")
def q_source_health(spark, sf_dir):
    """AGG-16, AGG-9: rows, values and key bounds of given tables, from their footers alone."""
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "events": "event_id"}
    parts = [footers.table_stats(spark, f"{sf_dir.rstrip('/')}/{t}.parquet", [k], [v]).toDF("n_rows", "key_min", "key_max", "n_values")
             .select(F.lit(t).alias("table_name"), "*")
             for (t, k), v in zip(keys.items(), ["o_totalprice", "c_mktsegment", "l_shipdate", "user_id"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _stored_daily(spark, sf_dir, name, tenants=False):
    path = scratch_path(spark, name)
    daily = base.daily_from_orders(spark, sf_dir, tenants=tenants)
    facts.write_partitioned(daily.withColumn("month", fx.month_key(F.col("date"))), path)
    return path


@register("stored_health")
def q_stored_health(spark, sf_dir):
    """AGG-16, AGG-13: stored tables with their rows, first and last day from footers; one table is missing."""
    leads = scratch_path(spark, "health_leads")
    facts.write_snapshot(base.leads_from_orders(spark, sf_dir), leads)
    stored = {"kpi_daily": (_stored_daily(spark, sf_dir, "health_daily"), "date"), "zoho_leads": (leads, None),
              "kpi_events": (f"{leads}-none", "date")}
    return footers.stored_health(spark, stored, ["kpi_daily", "zoho_leads", "kpi_events"])


@register("tenant_month_stats")
def q_tenant_month_stats(spark, sf_dir):
    """AGG-16 per month: rows, first and last day and values of the facts of every customer, from footers."""
    path = _stored_daily(spark, sf_dir, "tenant_stats", tenants=True)
    return footers.table_stats(spark, path, ["date"], ["ga_visitors", "notion_provision_eur"], by=["month"]).withColumn(
        "month", F.col("month").cast("string"))


@register("months_with_gaps")
def q_months_with_gaps(spark, sf_dir):
    """SRC-5: months that lack days, where every eleventh day of the daily facts was removed in odd months."""
    path = scratch_path(spark, "gap_months")
    daily = base.daily_from_orders(spark, sf_dir).where((F.dayofmonth("date") % 11 != 0) | (F.month("date") % 2 == 0))
    facts.write_partitioned(daily.withColumn("month", fx.month_key(F.col("date"))), path)
    return footers.months_with_gaps(spark, path)


# --- stored distinct-count sketches ------------------------------------------------------

def _event_sketches(spark, sf_dir, name, by=()):
    """Sketches of daily users, merged landing by landing; some events are late and some land twice."""
    path = scratch_path(spark, name)
    for part in base.event_landings(spark, sf_dir):
        known = part.where(F.col("user_id").isNotNull())
        sketches.merge_sketches(spark, path, sketches.daily_sketches(known, "user_id", "ts", by), by)
    return sketches.read_sketches(spark, path)


@register("approx_monthly_active_users")
def q_approx_monthly_active_users(spark, sf_dir):
    """SRC-14 at scale: exact active users, and whether the estimate from stored daily sketches is within its bound."""
    approx = sketches.trailing_distinct(_event_sketches(spark, sf_dir, "user_sketches"), out="mau_approx")
    exact = ev.monthly_active_users(base.read(spark, sf_dir, "events"))
    return sketches.compare(exact, approx, ["date"], "mau", "mau_approx").select("date", "mau", "within_bound")


@register("approx_active_users_by_kind")
def q_approx_active_users_by_kind(spark, sf_dir):
    """SRC-14 at scale with grouping keys: weekly active users of each event type."""
    by = ["event_type"]
    approx = sketches.trailing_distinct(_event_sketches(spark, sf_dir, "kind_sketches", by), 7, by, "wau_approx")
    exact = ev.monthly_active_users(base.read(spark, sf_dir, "events"), window_days=7, by=by).withColumnRenamed("mau", "wau")
    return sketches.compare(exact, approx, ["event_type", "date"], "wau", "wau_approx").select("event_type", "date", "wau", "within_bound")


@register("approx_customers_by_month")
def q_approx_customers_by_month(spark, sf_dir):
    """AGG-12 at scale: distinct customers per order status and month from daily sketches, stored in two batches that overlap."""
    orders, path = base.read(spark, sf_dir, "orders"), scratch_path(spark, "customer_sketches")
    k = F.col("o_orderkey") % 3
    for part in (orders.where(k < 2), orders.where(k > 0)):
        merged = sketches.daily_sketches(part, "o_custkey", "o_orderdate", ["o_orderstatus"])
        sketches.merge_sketches(spark, path, merged, ["o_orderstatus"])
    approx = sketches.distinct_by_month(sketches.read_sketches(spark, path), ["o_orderstatus"], "approx")
    exact = orders.groupBy("o_orderstatus", fx.month_key(F.col("o_orderdate").cast("date")).alias("month")).agg(
        F.count_distinct("o_custkey").alias("n_customers"))
    done = sketches.compare(exact, approx, ["o_orderstatus", "month"], "n_customers", "approx")
    return done.select(F.col("o_orderstatus").alias("status"), "month", "n_customers", "within_bound")
