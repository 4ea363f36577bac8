"""Base views over the driver tables.

* ``daily_from_orders`` (D): one daily fact row per order date.
* ``leads_from_orders`` (L): one CRM lead per order of the BUILDING segment.
* ``targets_frame`` (T): the literal yearly targets plus one planted
  duplicate, to exercise "first target row wins".

The mapping from orders to KPI columns is ours (the reference reads these
numbers from APIs); what matters is that every KPI gets realistic values,
zeros that mean "unknown" and integer/double types as in the daily table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_date_prefix
from ..functions.status import lead_status
from ..functions.text import name_of
from ..schemas import LOST_STAGES, TARGET_ROWS, TARGETS_SCHEMA, WAITING_STAGES, WON_STAGES

LEADS_AS_OF = dt.date(2001, 7, 15)
LEAD_SEGMENT = "BUILDING"
YTD_YEAR = 1998
SCOREBOARD_AS_OF = dt.date(1998, 7, 1)
OPEN_STAGE_O = "Qualifizierung"
OPEN_STAGE_P = "Angebot"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def daily_from_orders(spark: SparkSession, sf_dir: str, tenants: bool = False) -> DataFrame:
    """D: orders -> daily facts in the 16-KPI schema, plus ``seq``. With
    ``tenants``, one row per customer (column ``tenant``) and order date.

    One partial+final hash aggregation on the order date; the distinct
    customer count is planned by Catalyst as a two-level aggregation on
    (date, customer), so a hot day is spread before its final merge.
    """
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), "o_custkey", F.col("o_custkey").alias("tenant"), "o_orderstatus",
        "o_totalprice", "o_orderpriority")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    hi = pr.isin("1-URGENT", "2-HIGH")
    by = ["tenant"] if tenants else []
    a = o.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("cust"),
        F.count_if(pr == "5-LOW").alias("low"),
        F.sum(price).alias("price"),
        F.sum(F.when(st == "P", price)).alias("price_p"),
        F.count_if(st == "O").alias("n_o"),
        F.count_if(st == "P").alias("n_p"),
        F.count_if((st == "F") & hi).alias("won"),
        F.count_if((st == "F") & ~hi).alias("lost"),
        F.count_if((st == "P") & (pr == "5-LOW")).alias("waiting"),
        F.sum(F.col("o_custkey") % 97).alias("imp"),
        F.count_if(hi).alias("views"),
    )
    day = F.dayofmonth("date")
    return a.select(
        *by,
        "date",
        F.col("n").alias("ga_visitors"),
        F.col("cust").alias("ga_sessions"),
        (F.col("low").cast("double") * 100 / F.col("n")).alias("ga_bounce_rate"),
        F.when(day % 3 == 0, F.lit(0)).otherwise(F.col("cust")).cast("bigint").alias("notion_customers_total"),
        (F.col("n").cast("double") / 100).alias("notion_yearly_consumption_gwh"),
        F.col("price").cast("double").alias("notion_provision_eur"),
        F.coalesce(F.col("price_p"), F.lit(0)).cast("double").alias("manual_license_revenue"),
        F.when(day % 5 == 0, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("zoho_deals_total"),
        F.col("n_o").alias("zoho_deals_new"),
        F.col("n_p").alias("zoho_deals_active"),
        F.col("won").alias("zoho_deals_won"),
        F.col("lost").alias("zoho_deals_lost"),
        F.col("waiting").alias("zoho_deals_waiting"),
        F.col("cust").alias("auth0_mau"),
        F.col("imp").cast("bigint").alias("li_impressions"),
        F.col("views").alias("li_views"),
        F.unix_date("date").cast("bigint").alias("seq"),
    )


def stage_from_order(status, priority, key):
    """Deterministic CRM stage for an order (our test mapping)."""
    st, pr, k = F.col(status), F.col(priority), F.col(key)
    return (F.when((st == "F") & (pr == "1-URGENT"), F.lit(WON_STAGES[0]))
            .when((st == "F") & (pr == "2-HIGH") & (k % 2 == 0), F.lit(WON_STAGES[1]))
            .when((st == "F") & (pr == "2-HIGH"), F.lit(WON_STAGES[2]))
            .when(st == "F", F.lit(LOST_STAGES[0]))
            .when((st == "P") & (pr == "5-LOW"), F.lit(WAITING_STAGES[0]))
            .when(st == "O", F.lit(OPEN_STAGE_O))
            .otherwise(F.lit(OPEN_STAGE_P)))


def crm_deals_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders x customer as CRM deal records in their landed shape.

    ``Account_Name`` is raw text that is a ``{"name": ..}`` object, plain
    text or NULL (SCL-18); ``Created_Time`` is an ISO timestamp with offset
    (SCL-9). The customer join is an equi-join on the key; the segment
    filter is pushed into the customer scan.
    """
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    return j.select(
        k.alias("lead_id"),
        F.concat(F.lit("Deal "), k.cast("string")).alias("Deal_Name"),
        F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("name"))))
         .when(k % 3 == 1, F.col("c_name")).alias("Account_Name"),
        stage_from_order("o_orderstatus", "o_orderpriority", "o_orderkey").alias("Stage"),
        F.col("o_totalprice").alias("Amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("Created_Time"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("Closing_Date"),
        F.col("c_mktsegment").alias("Pipeline"),
    )


def leads_from_deals(deals: DataFrame, as_of=LEADS_AS_OF, segment: str | None = LEAD_SEGMENT) -> DataFrame:
    """FLT-6 + FLT-8: CRM deal records -> classified leads of one pipeline."""
    if segment is not None:
        deals = deals.where(F.col("Pipeline") == segment)
    created = iso_date_prefix("Created_Time")
    return deals.select(
        "lead_id",
        F.col("Deal_Name").alias("name"),
        name_of("Account_Name").alias("company"),
        F.col("Stage").alias("stage"),
        lead_status(F.col("Stage"), created, as_of).alias("status"),
        F.col("Amount").alias("amount"),
        created.alias("created_date"),
        F.to_date("Closing_Date").alias("closing_date"),
    )


def leads_from_orders(spark: SparkSession, sf_dir: str, as_of=LEADS_AS_OF) -> DataFrame:
    """L: the classified lead snapshot."""
    return leads_from_deals(crm_deals_from_orders(spark, sf_dir), as_of)


def targets_frame(spark: SparkSession) -> DataFrame:
    """T: the literal targets (in order) plus a later duplicate for ga_visitors."""
    rows = [(i + 1, *r) for i, r in enumerate(TARGET_ROWS)]
    rows.append((len(rows) + 1, "ga_visitors", 999.0, "Besucher", "Website"))
    schema = "row_pos INT, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TARGETS_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


# --- planted inputs for the fact-maintenance queries ---------------------------------

def _day_mod(m: int, r: int = 0):
    return F.dayofmonth("date") % m == r


def upsert_inputs(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing table and update batch with planted duplicates.

    existing: days with day%4 != 0, plus a second copy (seq + 1e6,
    visitors + 1) of days with day%7 == 0. updates: days with day%2 == 0
    (visitors x2, li_views NULL on day%3 == 0, seq + 2e6), plus a later copy
    of day%10 == 0 days (visitors x3, seq + 3e6).
    """
    keep = daily.where(~_day_mod(4))
    dup = keep.where(_day_mod(7)).withColumn("ga_visitors", F.col("ga_visitors") + 1) \
        .withColumn("seq", F.col("seq") + 1_000_000)
    existing = keep.unionByName(dup)
    nulled = F.when(_day_mod(3), F.lit(None).cast("bigint")).otherwise(F.col("li_views"))
    u1 = daily.where(_day_mod(2)).withColumn("ga_visitors", F.col("ga_visitors") * 2) \
        .withColumn("li_views", nulled).withColumn("seq", F.col("seq") + 2_000_000)
    u2 = daily.where(_day_mod(10)).withColumn("ga_visitors", F.col("ga_visitors") * 3) \
        .withColumn("li_views", nulled).withColumn("seq", F.col("seq") + 3_000_000)
    return existing, u1.unionByName(u2)


def tenant_upsert_inputs(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``upsert_inputs`` per tenant: customers order on few days, so the plan
    goes by tenant and day. existing: rows with (tenant + day) % 4 != 0, plus a
    second copy (seq + 1e6, visitors + 1) where tenant % 7 == 0. updates: rows
    with (tenant + day) % 2 == 0 (visitors x2, li_views NULL for even tenants,
    seq + 2e6)."""
    k = F.col("tenant") + F.dayofmonth("date")
    keep = daily.where(k % 4 != 0)
    dup = keep.where(F.col("tenant") % 7 == 0).withColumn("ga_visitors", F.col("ga_visitors") + 1) \
        .withColumn("seq", F.col("seq") + 1_000_000)
    upd = daily.where(k % 2 == 0).withColumn("ga_visitors", F.col("ga_visitors") * 2) \
        .withColumn("li_views", F.when(F.col("tenant") % 2 == 0, F.lit(None).cast("bigint")).otherwise(F.col("li_views"))) \
        .withColumn("seq", F.col("seq") + 2_000_000)
    return keep.unionByName(dup), upd


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, as a sheet holds it (NULL as an empty cell)."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def daily_text(daily: DataFrame) -> DataFrame:
    """Daily facts as text with planted bad cells: an impossible date on day
    11, a number beyond BIGINT on day 13, a word on day 17, an empty cell on day 19."""
    day = F.dayofmonth("date")
    t = as_text(daily.withColumn("_day", day))
    d = F.col("_day").cast("int")
    return t.withColumns({
        "date": F.when(d == 11, F.lit("2024-13-45")).otherwise(F.col("date")),
        "ga_visitors": F.when(d == 13, F.lit("99999999999999999999")).otherwise(F.col("ga_visitors")),
        "li_views": F.when(d == 17, F.lit("n/a")).when(d == 19, F.lit("")).otherwise(F.col("li_views")),
    }).drop("_day")


def backfill_inputs(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing table without day%3 == 0 days, and an analytics history for
    every day (visitors and sessions + 1000, bounce rate, date-based seq)."""
    existing = daily.where(~_day_mod(3))
    history = daily.select("date", (F.col("ga_visitors") + 1000).alias("ga_visitors"),
                           (F.col("ga_sessions") + 1000).alias("ga_sessions"), "ga_bounce_rate", "seq")
    return existing, history


def lineitem_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second KPI source for JON-1: lineitem by ship date."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_returnflag")
    return li.groupBy("date").agg(F.count(F.lit(1)).alias("li_impressions"),
                                  F.count_if(F.col("l_returnflag") == "R").alias("li_views"))


def event_landings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events as three landings of about eleven days. Of a landing's last day, events with id % 7 = 0 come with the
    next landing, and the others come again with it."""
    e = read(spark, sf_dir, "events")
    start = e.agg(F.min(F.col("ts").cast("date")).alias("d")).select("d").scalar()
    age = F.datediff(F.col("ts").cast("date"), start)
    own = F.least(F.lit(2), F.floor(age / 11))
    edge, late = age.isin(10, 21), F.col("event_id") % 7 == 0
    return [e.where(((own == k) & ~(edge & late)) | (edge & (own == k - 1))) for k in range(3)]
