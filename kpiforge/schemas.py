"""Table schemas, KPI kind table and schema helpers (SNK-5, PRJ-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These names and rows must equal the reference's for the
# results to line up (daily and monthly column names, target rows, KPI
# labels, lead stages, funnel labels). Kept together and in natural order.
# ---------------------------------------------------------------------------
DAILY_KPIS = [
    "ga_visitors",
    "ga_sessions",
    "ga_bounce_rate",
    "notion_customers_total",
    "notion_yearly_consumption_gwh",
    "notion_provision_eur",
    "manual_license_revenue",
    "zoho_deals_total",
    "zoho_deals_new",
    "zoho_deals_active",
    "zoho_deals_won",
    "zoho_deals_lost",
    "zoho_deals_waiting",
    "auth0_mau",
    "li_impressions",
    "li_views",
]

DOUBLE_KPIS = {
    "ga_bounce_rate",
    "notion_yearly_consumption_gwh",
    "notion_provision_eur",
    "manual_license_revenue",
}

MONTHLY_COLUMNS = [
    "month",
    "ga_visitors_sum",
    "ga_visitors_avg",
    "notion_customers_end",
    "notion_customers_new",
    "notion_yearly_consumption_gwh",
    "notion_provision_eur",
    "manual_license_revenue",
    "zoho_deals_total_end",
    "zoho_deals_new_end",
    "zoho_deals_active_end",
    "zoho_deals_won_end",
    "zoho_deals_lost_end",
    "zoho_deals_waiting_end",
    "auth0_mau_end",
    "li_impressions_sum",
    "li_views_sum",
]

MONTHLY_DOUBLE = {"notion_yearly_consumption_gwh", "notion_provision_eur", "manual_license_revenue"}

TARGET_ROWS = [
    ("ga_visitors", 120000.0, "Besucher", "Website"),
    ("notion_customers_total", 100.0, "Kunden", "Sales"),
    ("notion_yearly_consumption_gwh", 10.0, "GWh", "Energy"),
    ("zoho_deals_new", 500.0, "Leads", "Sales"),
    ("li_impressions", 600000.0, "Impressions", "Social"),
    ("li_views", 100000.0, "Views", "Social"),
]

# kpi, label
KPI_META_ROWS = [
    ("ga_visitors", "Website Besucher"),
    ("ga_sessions", "Sessions"),
    ("ga_bounce_rate", "Absprungrate"),
    ("notion_customers_total", "Kunden Gesamt"),
    ("notion_yearly_consumption_gwh", "Yearly Consumption"),
    ("notion_provision_eur", "Provision Energie"),
    ("manual_license_revenue", "Lizenzumsatz"),
    ("zoho_deals_new", "Neue Leads"),
    ("zoho_deals_total", "Leads Gesamt"),
    ("zoho_deals_won", "Leads gewonnen"),
    ("zoho_deals_lost", "Leads verloren"),
    ("zoho_deals_waiting", "Warteschleife"),
    ("zoho_deals_active", "Leads aktiv"),
    ("auth0_mau", "Active Users"),
    ("li_impressions", "LinkedIn Impressions"),
    ("li_views", "LinkedIn Views"),
]

# Year-to-date kinds: snapshot KPIs take the last known value in the year,
# the new-deal KPI counts all leads, everything else is summed.
SNAPSHOT_KPIS = ["notion_customers_total", "notion_yearly_consumption_gwh", "zoho_deals_total"]
LEAD_COUNT_KPIS = ["zoho_deals_new"]

# Scoreboard layout: two groups of three KPIs, in display order.
SCOREBOARD_LAYOUT = [
    ("sales_energy", 1, "notion_customers_total"),
    ("sales_energy", 2, "zoho_deals_new"),
    ("sales_energy", 3, "notion_yearly_consumption_gwh"),
    ("social_traffic", 1, "ga_visitors"),
    ("social_traffic", 2, "li_impressions"),
    ("social_traffic", 3, "li_views"),
]

# Daily KPI -> monthly column; any other KPI maps to itself.
MONTHLY_COLUMN_MAP = {
    "ga_visitors": "ga_visitors_sum",
    "notion_customers_total": "notion_customers_end",
    "notion_yearly_consumption_gwh": "notion_yearly_consumption_gwh",
    "zoho_deals_total": "zoho_deals_total_end",
    "li_impressions": "li_impressions_sum",
    "li_views": "li_views_sum",
}

WON_STAGES = ["Gewonnen, Freigabe erhalten", "Abgeschlossen, gewonnen", "Abgewickelt, -> OPS"]
LOST_STAGES = ["Abgeschlossen, verloren"]
WAITING_STAGES = ["Warteschleife"]
NEW_LEAD_DAYS = 14
LEAD_STATUSES = ["new", "active", "won", "lost", "waiting"]

# Funnel rows: label and the lead count feeding it.
FUNNEL_STAGES = [
    ("Gesamt", "total"),
    ("Aktiv", "active"),
    ("Aktiv (Neu)", "new"),
    ("Warteschleife", "waiting"),
    ("Gewonnen", "won"),
    ("Verloren", "lost"),
]

LEAD_DISPLAY_LABELS = [
    ("name", "Name"),
    ("company", "Unternehmen"),
    ("stage", "Stage"),
    ("amount", "Betrag (€)"),
    ("created_date", "Erstellt"),
    ("closing_date", "Abschluss"),
]
# ---------------------------------------------------------------------------


def _kpi_type(name: str) -> T.DataType:
    return T.DoubleType() if name in DOUBLE_KPIS else T.LongType()


DAILY_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(k, _kpi_type(k)) for k in DAILY_KPIS]
    + [T.StructField("seq", T.LongType())]
)

MONTHLY_SCHEMA = T.StructType(
    [T.StructField("month", T.StringType())]
    + [T.StructField(c, T.DoubleType() if c in MONTHLY_DOUBLE else T.LongType()) for c in MONTHLY_COLUMNS[1:]]
)

TARGETS_SCHEMA = T.StructType([
    T.StructField("kpi", T.StringType()),
    T.StructField("target_yearly", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("category", T.StringType()),
])

LEADS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("created_date", T.DateType()),
    T.StructField("closing_date", T.DateType()),
])

KPI_META_SCHEMA = T.StructType([
    T.StructField("kpi", T.StringType()),
    T.StructField("label", T.StringType()),
])


def kpi_meta(spark: SparkSession) -> DataFrame:
    """KPI metadata as a 16-row frame (small by construction, safe to broadcast)."""
    return spark.createDataFrame(KPI_META_ROWS, KPI_META_SCHEMA)


def default_targets(spark: SparkSession) -> DataFrame:
    """SRC-16: the literal target rows."""
    return spark.createDataFrame(TARGET_ROWS, TARGETS_SCHEMA)


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ-6: add every column of ``schema`` absent from ``df`` as a typed NULL."""
    present = set(df.columns)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in present]
    return df.select("*", *extra) if extra else df


def enforce_schema(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """SNK-5: fixed column order and types at a sink.

    With ``strict`` the column set must match exactly (drift fails instead of
    silently renaming columns); otherwise missing columns become NULL and
    extra columns are dropped.
    """
    if strict:
        want, have = [f.name for f in schema.fields], df.columns
        missing = [c for c in want if c not in have]
        extra = [c for c in have if c not in want]
        if missing or extra:
            raise ValueError(f"schema drift: missing={missing} extra={extra}")
    return df.to(schema)
