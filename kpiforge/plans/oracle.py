"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code, straight from the operator
definitions, over the pre-registered driver views. Shared base views are
CTE fragments; each query appends its own CTEs and final SELECT.
"""

from __future__ import annotations

# Fixed values, stated again here so that the oracle does not depend on the library's.
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
FUNNEL_STAGES = [
    ("Gesamt", "total"),
    ("Aktiv", "active"),
    ("Aktiv (Neu)", "new"),
    ("Warteschleife", "waiting"),
    ("Gewonnen", "won"),
    ("Verloren", "lost"),
]
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
MONTHLY_COLUMN_MAP = {
    "ga_visitors": "ga_visitors_sum",
    "notion_customers_total": "notion_customers_end",
    "notion_yearly_consumption_gwh": "notion_yearly_consumption_gwh",
    "zoho_deals_total": "zoho_deals_total_end",
    "li_impressions": "li_impressions_sum",
    "li_views": "li_views_sum",
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
SCOREBOARD_LAYOUT = [
    ("sales_energy", 1, "notion_customers_total"),
    ("sales_energy", 2, "zoho_deals_new"),
    ("sales_energy", 3, "notion_yearly_consumption_gwh"),
    ("social_traffic", 1, "ga_visitors"),
    ("social_traffic", 2, "li_impressions"),
    ("social_traffic", 3, "li_views"),
]
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
TARGET_ROWS = [
    ("ga_visitors", 120000.0, "Besucher", "Website"),
    ("notion_customers_total", 100.0, "Kunden", "Sales"),
    ("notion_yearly_consumption_gwh", 10.0, "GWh", "Energy"),
    ("zoho_deals_new", 500.0, "Leads", "Sales"),
    ("li_impressions", 600000.0, "Impressions", "Social"),
    ("li_views", 100000.0, "Views", "Social"),
]
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


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


# D: daily facts from orders
D_CTE = """
o_ AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
),
a_ AS (
  SELECT date, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS cust,
    CAST(COUNT_IF(o_orderpriority = '5-LOW') AS BIGINT) AS low,
    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS price,
    SUM(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS price_p,
    CAST(COUNT_IF(o_orderstatus = 'O') AS BIGINT) AS n_o,
    CAST(COUNT_IF(o_orderstatus = 'P') AS BIGINT) AS n_p,
    CAST(COUNT_IF(o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS won,
    CAST(COUNT_IF(o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS lost,
    CAST(COUNT_IF(o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS BIGINT) AS waiting,
    SUM(o_custkey % 97) AS imp,
    CAST(COUNT_IF(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS views
  FROM o_ GROUP BY date
),
d AS (
  SELECT date,
    CAST(n AS BIGINT) AS ga_visitors,
    CAST(cust AS BIGINT) AS ga_sessions,
    CAST(low AS DOUBLE) * 100 / n AS ga_bounce_rate,
    CAST(CASE WHEN day(date) % 3 = 0 THEN 0 ELSE cust END AS BIGINT) AS notion_customers_total,
    CAST(n AS DOUBLE) / 100 AS notion_yearly_consumption_gwh,
    CAST(price AS DOUBLE) AS notion_provision_eur,
    CAST(COALESCE(price_p, 0) AS DOUBLE) AS manual_license_revenue,
    CAST(CASE WHEN day(date) % 5 = 0 THEN 0 ELSE n END AS BIGINT) AS zoho_deals_total,
    CAST(n_o AS BIGINT) AS zoho_deals_new,
    CAST(n_p AS BIGINT) AS zoho_deals_active,
    CAST(won AS BIGINT) AS zoho_deals_won,
    CAST(lost AS BIGINT) AS zoho_deals_lost,
    CAST(waiting AS BIGINT) AS zoho_deals_waiting,
    CAST(cust AS BIGINT) AS auth0_mau,
    CAST(imp AS BIGINT) AS li_impressions,
    CAST(views AS BIGINT) AS li_views,
    CAST(date - DATE '1970-01-01' AS BIGINT) AS seq
  FROM a_
)"""

STAGES_SQL = f"""CASE
      WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN {_q(WON_STAGES[0])}
      WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN {_q(WON_STAGES[1])}
      WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN {_q(WON_STAGES[2])}
      WHEN o_orderstatus = 'F' THEN {_q(LOST_STAGES[0])}
      WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN {_q(WAITING_STAGES[0])}
      WHEN o_orderstatus = 'O' THEN 'Qualifizierung'
      ELSE 'Angebot' END"""

# L: classified leads (as_of 2001-07-15 -> new cutoff 2001-07-01)
L_CTE = f"""
l0_ AS (
  SELECT o_orderkey AS lead_id,
    'Deal ' || CAST(o_orderkey AS VARCHAR) AS name,
    CASE WHEN o_orderkey % 3 IN (0, 1) THEN c_name ELSE '' END AS company,
    {STAGES_SQL} AS stage,
    o_totalprice AS amount,
    CAST(o_orderdate AS DATE) AS created_date,
    CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS closing_ts
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING'
),
l AS (
  SELECT lead_id, name, company, stage,
    CASE WHEN stage IN {_in(WON_STAGES)} THEN 'won'
         WHEN stage IN {_in(LOST_STAGES)} THEN 'lost'
         WHEN stage IN {_in(WAITING_STAGES)} THEN 'waiting'
         WHEN created_date >= DATE '2001-07-01' THEN 'new'
         ELSE 'active' END AS status,
    amount, created_date, CAST(closing_ts AS DATE) AS closing_date
  FROM l0_
)"""

_targets_rows = [(i + 1, *r) for i, r in enumerate(TARGET_ROWS)] + [(len(TARGET_ROWS) + 1, "ga_visitors", 999.0,
                                                                    "Besucher", "Website")]
T_CTE = "t AS (SELECT * FROM (VALUES " + ", ".join(
    f"({p}, {_q(k)}, CAST({v} AS DOUBLE), {_q(u)}, {_q(c)})" for p, k, v, u, c in _targets_rows
) + ") v(row_pos, kpi, target_yearly, unit, category))"

META_CTE = "meta AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(k)}, {_q(lbl)})" for k, lbl in KPI_META_ROWS) + ") v(kpi, label))"

LAYOUT_CTE = "layout AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(g)}, {p}, {_q(k)})" for g, p, k in SCOREBOARD_LAYOUT) + ") v(grp, pos, kpi))"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def monthly_cte(src: str = "d", by: str = "", name: str = "m") -> str:
    """Monthly rollup (AGG-6 + WIN-5) of daily facts ``src`` per ``by`` (comma list) and month."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
{name}0_ AS (
  SELECT {keys}strftime(date, '%Y-%m') AS month,
    CAST(SUM(ga_visitors) AS BIGINT) AS ga_visitors_sum,
    CAST(trunc(AVG(ga_visitors)) AS BIGINT) AS ga_visitors_avg,
    arg_max(notion_customers_total, seq) FILTER (WHERE notion_customers_total > 0) AS cust_end,
    CAST(round(CAST(arg_max(notion_yearly_consumption_gwh, seq) FILTER (WHERE notion_customers_total > 0)
      AS DECIMAL(38,9)), 2) AS DOUBLE) AS gwh,
    CAST(round(CAST(arg_max(notion_provision_eur, seq) FILTER (WHERE notion_customers_total > 0)
      AS DECIMAL(38,9)), 2) AS DOUBLE) AS prov,
    CAST(round(SUM(CAST(manual_license_revenue AS DECIMAL(38,9))), 2) AS DOUBLE) AS lic,
    arg_max(zoho_deals_total, seq) FILTER (WHERE zoho_deals_total > 0) AS total_end,
    arg_max(zoho_deals_new, seq) FILTER (WHERE zoho_deals_new > 0) AS new_end,
    arg_max(zoho_deals_active, seq) FILTER (WHERE zoho_deals_active > 0) AS active_end,
    arg_max(zoho_deals_won, seq) FILTER (WHERE zoho_deals_won > 0) AS won_end,
    arg_max(zoho_deals_lost, seq) FILTER (WHERE zoho_deals_lost > 0) AS lost_end,
    arg_max(zoho_deals_waiting, seq) FILTER (WHERE zoho_deals_waiting > 0) AS waiting_end,
    MAX(auth0_mau) AS mau,
    CAST(SUM(li_impressions) AS BIGINT) AS li_impressions_sum,
    CAST(SUM(li_views) AS BIGINT) AS li_views_sum
  FROM {src} GROUP BY ALL
),
{name} AS (
  SELECT {keys}month, ga_visitors_sum, ga_visitors_avg,
    CAST(COALESCE(cust_end, 0) AS BIGINT) AS notion_customers_end,
    CAST(CASE WHEN cust_end IS NULL THEN 0
      WHEN prev_end IS NULL THEN cust_end
      ELSE GREATEST(0, cust_end - prev_end) END AS BIGINT) AS notion_customers_new,
    COALESCE(gwh, 0.0) AS notion_yearly_consumption_gwh,
    COALESCE(prov, 0.0) AS notion_provision_eur,
    COALESCE(lic, 0.0) AS manual_license_revenue,
    CAST(COALESCE(total_end, 0) AS BIGINT) AS zoho_deals_total_end,
    CAST(COALESCE(new_end, 0) AS BIGINT) AS zoho_deals_new_end,
    CAST(COALESCE(active_end, 0) AS BIGINT) AS zoho_deals_active_end,
    CAST(COALESCE(won_end, 0) AS BIGINT) AS zoho_deals_won_end,
    CAST(COALESCE(lost_end, 0) AS BIGINT) AS zoho_deals_lost_end,
    CAST(COALESCE(waiting_end, 0) AS BIGINT) AS zoho_deals_waiting_end,
    CAST(COALESCE(mau, 0) AS BIGINT) AS auth0_mau_end,
    li_impressions_sum, li_views_sum
  FROM (SELECT *, LAST_VALUE(cust_end IGNORE NULLS) OVER ({part}ORDER BY month
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM {name}0_) x
)"""


MONTHLY_CTE = monthly_cte()


ORACLE: dict[str, str] = {}

ORACLE["monthly_rollup"] = with_ctes(D_CTE, MONTHLY_CTE) + "SELECT * FROM m"

ORACLE["monthly_rollup_variant"] = with_ctes(D_CTE) + """
SELECT strftime(date, '%Y-%m') AS month,
  CAST(SUM(ga_visitors) AS BIGINT) AS ga_visitors_sum,
  CAST(round_even(AVG(ga_visitors), 0) AS BIGINT) AS ga_visitors_avg,
  CAST(arg_max(notion_customers_total, seq) AS BIGINT) AS notion_customers_end,
  CAST(arg_max(notion_customers_total, seq) - arg_min(notion_customers_total, seq) AS BIGINT) AS notion_customers_new,
  arg_max(notion_yearly_consumption_gwh, seq) AS notion_yearly_consumption_gwh,
  CAST(SUM(zoho_deals_new) AS BIGINT) AS zoho_deals_sum,
  CAST(SUM(zoho_deals_won) AS BIGINT) AS zoho_deals_won_sum,
  CAST(SUM(li_impressions) AS BIGINT) AS li_impressions_sum,
  CAST(SUM(li_views) AS BIGINT) AS li_views_sum
FROM d GROUP BY 1"""


def _pct(cur: str, prev: str) -> str:
    return (f"CASE WHEN {prev} > 0 THEN (CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) "
            f"/ CAST({prev} AS DOUBLE) * 100 END")


ORACLE["period_sum_delta"] = with_ctes(D_CTE, """
r AS (SELECT ga_visitors, li_impressions, ROW_NUMBER() OVER (ORDER BY date DESC, seq DESC) AS rn,
      COUNT(*) OVER () AS total FROM d),
p AS (SELECT * FROM (VALUES (7), (14), (30), (90)) v(days)),
k AS (SELECT * FROM (VALUES ('ga_visitors'), ('li_impressions')) v(kpi)),
x AS (
  SELECT p.days, k.kpi,
    CAST(COALESCE(SUM(CASE WHEN rn <= p.days THEN
      CASE k.kpi WHEN 'ga_visitors' THEN ga_visitors ELSE li_impressions END END), 0) AS BIGINT) AS current,
    CAST(CASE WHEN MAX(total) >= 2 * p.days THEN COALESCE(SUM(CASE WHEN rn > p.days AND rn <= 2 * p.days THEN
      CASE k.kpi WHEN 'ga_visitors' THEN ga_visitors ELSE li_impressions END END), 0) ELSE 0 END AS BIGINT) AS previous
  FROM r, p, k GROUP BY p.days, k.kpi
)""") + f"SELECT days, kpi, current, previous, {_pct('current', 'previous')} AS delta_pct FROM x"

ORACLE["trailing_sum_series"] = with_ctes(D_CTE, """
x AS (
  SELECT date, ga_visitors AS value,
    CAST(SUM(ga_visitors) OVER (ORDER BY date, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS current,
    CAST(CASE WHEN COUNT(*) OVER (ORDER BY date, seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14
      THEN SUM(ga_visitors) OVER (ORDER BY date, seq ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) END AS BIGINT)
      AS previous
  FROM d
)""") + f"SELECT date, value, current, previous, {_pct('current', 'previous')} AS delta_pct FROM x"

ORACLE["offset_delta"] = with_ctes(D_CTE, """
x AS (SELECT date, ga_visitors AS value, LAG(ga_visitors, 7) OVER (ORDER BY date, seq) AS previous FROM d)""") + """
SELECT date, value, previous,
  CASE WHEN previous IS NOT NULL AND previous <> 0 THEN CAST(value AS DOUBLE) - CAST(previous AS DOUBLE)
       ELSE 0.0 END AS delta_abs,
  CASE WHEN previous IS NOT NULL AND previous <> 0 THEN
       (CAST(value AS DOUBLE) - CAST(previous AS DOUBLE)) / CAST(previous AS DOUBLE) * 100 ELSE 0.0 END AS delta_pct
FROM x"""

ORACLE["last_known_delta"] = with_ctes(D_CTE) + """
SELECT date, notion_customers_total AS value,
  LAG(notion_customers_total) OVER (ORDER BY date, seq) AS previous,
  notion_customers_total - LAG(notion_customers_total) OVER (ORDER BY date, seq) AS delta
FROM d WHERE notion_customers_total > 0"""

ORACLE["trailing_range"] = with_ctes(D_CTE, "mx AS (SELECT MAX(date) AS m, COUNT(*) AS n FROM d)") + """
SELECT date, ga_visitors, ga_sessions, ga_bounce_rate, zoho_deals_total, li_impressions, auth0_mau,
  notion_yearly_consumption_gwh, m AS last_update, n AS n_days
FROM d, mx WHERE date >= m - 30"""

ORACLE["series_long"] = with_ctes(D_CTE) + """
SELECT date, 'ga_visitors' AS series, 'Besucher' AS label, CAST(ga_visitors AS DOUBLE) AS value FROM d
UNION ALL
SELECT date, 'ga_sessions' AS series, 'Sessions' AS label, CAST(ga_sessions AS DOUBLE) AS value FROM d"""

ORACLE["kpi_cards"] = with_ctes(D_CTE, L_CTE, """
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC, seq DESC) AS rn, MAX(date) OVER () AS maxd,
      COUNT(*) OVER () AS total FROM d),
f AS (SELECT *, date >= maxd - 30 AS win FROM r),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY (win AND notion_customers_total > 0)
      ORDER BY date DESC, seq DESC) AS crk FROM f),
a AS (
  SELECT
    CAST(COALESCE(SUM(CASE WHEN rn <= 30 AND win THEN ga_visitors END), 0) AS BIGINT) AS visitors,
    CAST(CASE WHEN MAX(total) >= 60 THEN COALESCE(SUM(CASE WHEN rn > 30 AND rn <= 60 THEN ga_visitors END), 0)
      ELSE 0 END AS BIGINT) AS visitors_prev,
    CAST(COALESCE(SUM(CASE WHEN rn <= 30 AND win THEN li_impressions END), 0) AS BIGINT) AS impressions,
    CAST(CASE WHEN MAX(total) >= 60 THEN COALESCE(SUM(CASE WHEN rn > 30 AND rn <= 60 THEN li_impressions END), 0)
      ELSE 0 END AS BIGINT) AS impressions_prev,
    CAST(COALESCE(MAX(CASE WHEN win AND notion_customers_total > 0 AND crk = 1 THEN notion_customers_total END), 0)
      AS BIGINT) AS customers,
    CAST(COALESCE(MAX(CASE WHEN win AND notion_customers_total > 0 AND crk = 2 THEN notion_customers_total END), 0)
      AS BIGINT) AS customers_prev,
    COALESCE(arg_max(notion_yearly_consumption_gwh, seq) FILTER (WHERE win AND notion_yearly_consumption_gwh > 0),
      0.0) AS gwh,
    COALESCE(CAST(round(CAST(arg_max(notion_provision_eur, seq) FILTER (WHERE win AND notion_provision_eur > 0)
      AS DECIMAL(38,9)), 0) AS DOUBLE), 0.0) AS provision,
    COALESCE(CAST(round(SUM(CAST(CASE WHEN rn <= 30 AND win THEN manual_license_revenue END AS DECIMAL(38,9))), 0)
      AS DOUBLE), 0.0) AS license,
    CAST(COALESCE(arg_max(auth0_mau, seq) FILTER (WHERE win AND auth0_mau > 0), 0) AS BIGINT) AS mau
  FROM c
),
lc AS (SELECT CAST(COUNT_IF(status IN ('new', 'active')) AS BIGINT) AS active_leads, CAST(COUNT_IF(status = 'new') AS BIGINT) AS new_leads FROM l)
""") + f"""SELECT a.*, {_pct('visitors', 'visitors_prev')} AS visitors_delta_pct,
  {_pct('impressions', 'impressions_prev')} AS impressions_delta_pct,
  CASE WHEN customers_prev > 0 THEN customers - customers_prev END AS customers_delta,
  lc.active_leads, lc.new_leads
FROM a, lc"""

ORACLE["lead_status"] = with_ctes(L_CTE) + "SELECT * FROM l"

LEAD_COUNTS_SQL = """SELECT COUNT(*) AS total, CAST(COUNT_IF(status = 'new') AS BIGINT) AS "new", CAST(COUNT_IF(status = 'active') AS BIGINT) AS active,
  CAST(COUNT_IF(status = 'won') AS BIGINT) AS won, CAST(COUNT_IF(status = 'lost') AS BIGINT) AS lost, CAST(COUNT_IF(status = 'waiting') AS BIGINT) AS waiting FROM l"""

ORACLE["lead_status_counts"] = with_ctes(L_CTE) + LEAD_COUNTS_SQL

ORACLE["lead_funnel"] = with_ctes(L_CTE, f"lc AS ({LEAD_COUNTS_SQL})", "s AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS pos, {_q(label)} AS stage, \"{src}\" AS value FROM lc"
    for i, (label, src) in enumerate(FUNNEL_STAGES)) + ")") + """
SELECT pos, stage, value,
  CASE WHEN FIRST_VALUE(value) OVER (ORDER BY pos) > 0
       THEN CAST(value AS DOUBLE) / CAST(FIRST_VALUE(value) OVER (ORDER BY pos) AS DOUBLE) * 100 END AS pct_of_first
FROM s"""

ORACLE["lead_lists"] = with_ctes(L_CTE, """
sel AS (SELECT * FROM l WHERE status IN ('new', 'active')),
sz AS (SELECT status, COUNT(*) AS list_size FROM sel GROUP BY status)""") + """
SELECT sel.status, name AS "Name", company AS "Unternehmen", stage AS "Stage", amount AS "Betrag (€)",
  created_date AS "Erstellt", closing_date AS "Abschluss", list_size
FROM sel JOIN sz ON sel.status = sz.status"""

ORACLE["won_stage_counts"] = with_ctes(L_CTE) + f"""
SELECT stage, COUNT(*) AS deals FROM l WHERE stage IN {_in(WON_STAGES)} GROUP BY ROLLUP (stage)"""

ORACLE["newest_leads"] = with_ctes(L_CTE) + """
SELECT lead_id, name, company, stage, created_date,
  trim(concat_ws(' ', COALESCE(name, ''), COALESCE(company, ''))) AS display_name
FROM l ORDER BY created_date DESC, lead_id LIMIT 5"""

# --- targets ---------------------------------------------------------------------------


def _exact(x: str) -> str:
    """Sum of a double through two decimals of nine digits each."""
    head = f"CAST({x} AS DECIMAL(38,9))"
    tail = f"CAST(({x} - CAST({head} AS DOUBLE)) * 1e18::DOUBLE AS DECIMAL(38,9))"
    return f"(CAST(SUM({head}) AS DOUBLE) + CAST(SUM({tail}) AS DOUBLE) / 1e18::DOUBLE)"


def _ytd_sql(kpis, y0: int) -> str:
    parts = []
    for k in kpis:
        if k in SNAPSHOT_KPIS:
            v, kind = f"CAST(arg_max({k}, seq) FILTER (WHERE {k} > 0) AS DOUBLE)", "snapshot"
        elif k in LEAD_COUNT_KPIS:
            v, kind = "(SELECT CAST(COUNT(*) AS DOUBLE) FROM l)", "lead_count"
        elif k in DOUBLE_KPIS:
            v, kind = _exact(k), "sum"
        else:
            v, kind = f"CAST(SUM({k}) AS DOUBLE)", "sum"
        src = "" if kind == "lead_count" else " FROM yr"
        parts.append(f"SELECT '{k}' AS kpi, '{kind}' AS kind, COALESCE({v}, 0.0) AS ytd{src}")
    return (f"yr AS (SELECT * FROM d WHERE date >= DATE '{y0}-01-01' AND date < DATE '{y0 + 1}-01-01'),\n"
            f"y AS ({' UNION ALL '.join(parts)})")


ORACLE["ytd_values"] = with_ctes(D_CTE, L_CTE, _ytd_sql(DAILY_KPIS, 1998)) + "SELECT * FROM y"

_LAYOUT_KPIS = [k for _g, _p, k in SCOREBOARD_LAYOUT]
SCOREBOARD_CTE = with_ctes(D_CTE, L_CTE, T_CTE, META_CTE, LAYOUT_CTE, _ytd_sql(_LAYOUT_KPIS, 1998), """
tf AS (SELECT kpi, target_yearly, unit FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi ORDER BY row_pos) AS rn
       FROM t) x WHERE rn = 1),
pg AS (SELECT CAST(dayofyear(DATE '1998-07-01') AS DOUBLE) / dayofyear(DATE '1998-12-31') AS p),
sb0 AS (
  SELECT layout.grp, layout.pos, y.kpi, COALESCE(meta.label, y.kpi) AS label, tf.unit, y.ytd,
    tf.target_yearly AS target, pg.p AS year_progress, tf.target_yearly * pg.p AS prorated_target,
    CASE WHEN tf.target_yearly > 0 THEN y.ytd / tf.target_yearly * 100 ELSE 0.0 END AS pct,
    CASE WHEN y.ytd >= tf.target_yearly * pg.p THEN 'on_track'
         WHEN y.ytd >= tf.target_yearly * pg.p * 0.7 THEN 'slightly_behind'
         ELSE 'behind' END AS status
  FROM y JOIN layout ON y.kpi = layout.kpi JOIN tf ON y.kpi = tf.kpi LEFT JOIN meta ON y.kpi = meta.kpi, pg
),
sb AS (SELECT *, CASE WHEN pct >= 100 THEN 'success' WHEN pct >= 70 THEN 'warning' ELSE 'danger' END AS band FROM sb0)
""")

ORACLE["target_scoreboard"] = SCOREBOARD_CTE + "SELECT * FROM sb"

ORACLE["progress_record"] = SCOREBOARD_CTE + """
SELECT grp, pos, kpi, ytd AS value, target, LEAST(pct, 120.0) AS percentage,
  CASE WHEN LEAST(pct, 120.0) >= 100 THEN 'success' WHEN LEAST(pct, 120.0) >= 70 THEN 'warning'
       ELSE 'danger' END AS band
FROM sb"""

_cmap = dict(MONTHLY_COLUMN_MAP)
_cmap.setdefault("zoho_deals_new", "zoho_deals_new_end")
_mcol_case = "CASE kpi " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in _cmap.items()) + " ELSE kpi END"
ORACLE["month_vs_target"] = with_ctes(D_CTE, MONTHLY_CTE, T_CTE, f"""
tf AS (SELECT kpi, {_mcol_case} AS mcol, target_yearly / 12 AS target_month
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi ORDER BY row_pos) AS rn FROM t) x WHERE rn = 1),
ml AS ({' UNION ALL '.join(f"SELECT month, '{c}' AS mcol, CAST({c} AS DOUBLE) AS actual FROM m"
                           for c in MONTHLY_COLUMNS[1:])})""") + """
SELECT tf.kpi, ml.month, ml.actual, tf.target_month FROM ml JOIN tf ON ml.mcol = tf.mcol"""

# --- fact maintenance --------------------------------------------------------------------

_KPI_DEFAULT = {k: ("0.0" if k in DOUBLE_KPIS else "0") for k in DAILY_KPIS}


def _daily_select(overrides: dict) -> str:
    cols = ["date"] + list(DAILY_KPIS) + ["seq"]
    return ", ".join(f"{overrides[c]} AS {c}" if c in overrides else c for c in cols)


_nulled = "CASE WHEN day(date) % 3 = 0 THEN NULL ELSE li_views END"
UPSERT_CTE = with_ctes(D_CTE, f"""
ex AS (
  SELECT {_daily_select({})} FROM d WHERE day(date) % 4 <> 0
  UNION ALL
  SELECT {_daily_select({'ga_visitors': 'ga_visitors + 1', 'seq': 'seq + 1000000'})}
  FROM d WHERE day(date) % 4 <> 0 AND day(date) % 7 = 0
),
up AS (
  SELECT {_daily_select({'ga_visitors': 'ga_visitors * 2', 'li_views': _nulled, 'seq': 'seq + 2000000'})}
  FROM d WHERE day(date) % 2 = 0
  UNION ALL
  SELECT {_daily_select({'ga_visitors': 'ga_visitors * 3', 'li_views': _nulled, 'seq': 'seq + 3000000'})}
  FROM d WHERE day(date) % 10 = 0
),
ul AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY seq DESC) AS rn FROM up) x WHERE rn = 1),
ef AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY seq) AS rn FROM ex) x WHERE rn = 1)""")

ORACLE["upsert_daily"] = UPSERT_CTE + "SELECT ul.date, " + ", ".join(
    f"COALESCE(ul.{k}, ef.{k}, {_KPI_DEFAULT[k]}) AS {k}" for k in DAILY_KPIS) + """, ul.seq
FROM ul LEFT JOIN ef ON ul.date = ef.date
UNION ALL
SELECT * FROM ex WHERE date NOT IN (SELECT date FROM up)"""

ORACLE["backfill_daily"] = with_ctes(D_CTE, f"""
ex AS (SELECT {_daily_select({})} FROM d WHERE day(date) % 3 <> 0)""") + "SELECT * FROM ex UNION ALL SELECT " + \
    _daily_select({**{k: _KPI_DEFAULT[k] for k in DAILY_KPIS},
                   'ga_visitors': 'ga_visitors + 1000', 'ga_sessions': 'ga_sessions + 1000',
                   'ga_bounce_rate': 'ga_bounce_rate'}) + " FROM d WHERE date NOT IN (SELECT date FROM ex)"

ORACLE["merge_sources"] = with_ctes(D_CTE, """
s2 AS (SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS li_impressions,
       CAST(COUNT_IF(l_returnflag = 'R') AS BIGINT) AS li_views FROM lineitem GROUP BY 1)""") + """
SELECT COALESCE(d.date, s2.date) AS date,
  CAST(COALESCE(d.ga_visitors, 0) AS BIGINT) AS ga_visitors,
  CAST(COALESCE(d.ga_sessions, 0) AS BIGINT) AS ga_sessions,
  CAST(COALESCE(s2.li_views, d.li_views, 0) AS BIGINT) AS li_views,
  CAST(COALESCE(s2.li_impressions, 0) AS BIGINT) AS li_impressions
FROM d FULL OUTER JOIN s2 ON d.date = s2.date"""

# --- scalar functions ----------------------------------------------------------------------

ORACLE["parse_number_locale"] = """
SELECT o_orderkey,
  ['en_grouped', 'de_grouped', 'comma_decimal', 'plain', 'padded', 'currency_suffix', 'commas_only',
   'null'][o_orderkey % 8 + 1] AS fmt,
  CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3, 4) THEN o_totalprice
       WHEN o_orderkey % 8 = 6 THEN floor(o_totalprice) / 1000
       ELSE 0.0 END AS value
FROM orders"""

ORACLE["coerce_targets"] = """
SELECT 'kpi_' || CAST(o_orderkey AS VARCHAR) AS kpi,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_totalprice END AS target_yearly
FROM orders"""

ORACLE["date_keys"] = """
WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date,
  CAST(strptime(strftime(date, '%Y%m%d'), '%Y%m%d') AS DATE) AS parsed,
  strftime(date, '%Y-%m') AS month,
  CAST(date - 1 AS DATE) AS yesterday,
  CAST(date - 14 AS DATE) AS cutoff_14d,
  CAST(year(date) AS INTEGER) AS year,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year,
  CAST(dayofyear(make_date(year(date), 12, 31)) AS INTEGER) AS days_in_year,
  CAST(dayofyear(date) AS DOUBLE) / dayofyear(make_date(year(date), 12, 31)) AS year_progress,
  epoch_ms(CAST(date AS TIMESTAMP)) AS day_start_ms,
  epoch_ms(CAST(date + 1 AS TIMESTAMP)) AS day_end_ms,
  CASE WHEN isodow(date) >= 6 THEN 0.6 ELSE 1.0 END::DOUBLE AS weekend_factor
FROM x"""

# --- event reports ---------------------------------------------------------------------------

SESSIONS_CTE = """
ev AS (
  SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts,
         LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
  FROM events
),
fl AS (
  SELECT *, (prev_ts IS NULL OR ts > prev_ts + INTERVAL 30 MINUTE) AS is_start,
         (next_ts IS NULL OR next_ts > ts + INTERVAL 30 MINUTE) AS is_end
  FROM ev
)"""

_METRICS_SQL = """COUNT(DISTINCT user_id) AS visitors, CAST(COUNT_IF(is_start) AS BIGINT) AS sessions,
  CAST(COUNT_IF(is_start AND is_end) AS BIGINT) AS bounces, CAST(COUNT_IF(event_type = 'view') AS BIGINT) AS pageviews, COUNT(*) AS events"""

_BOUNCE_SQL = "CASE WHEN sessions > 0 THEN CAST(bounces AS DOUBLE) * 100 / CAST(sessions AS DOUBLE) ELSE 0.0 END"

ORACLE["metric_report_daily"] = with_ctes(SESSIONS_CTE, f"""
x AS (SELECT CAST(ts AS DATE) AS date, {_METRICS_SQL} FROM fl GROUP BY 1)""") + \
    f"SELECT *, {_BOUNCE_SQL} AS bounce_rate FROM x"

ORACLE["metric_report_ranges"] = with_ctes(SESSIONS_CTE, """
r AS (SELECT label, pos, DATE '2024-01-31' - s AS rs, DATE '2024-01-31' - e AS re FROM (VALUES
  ('today', 1, 0, 0), ('yesterday', 2, 1, 1), ('last_7_days', 3, 7, 1), ('last_30_days', 4, 30, 1)) v(label, pos, s, e)),
x AS (SELECT r.label, r.pos, COUNT(DISTINCT user_id) AS visitors, COALESCE(CAST(COUNT_IF(is_start) AS BIGINT), 0) AS sessions,
        COALESCE(CAST(COUNT_IF(is_start AND is_end) AS BIGINT), 0) AS bounces,
        COALESCE(CAST(COUNT_IF(event_type = 'view') AS BIGINT), 0) AS pageviews, COUNT(event_id) AS events
      FROM r LEFT JOIN fl ON CAST(fl.ts AS DATE) BETWEEN r.rs AND r.re GROUP BY r.label, r.pos)""") + \
    f"SELECT *, {_BOUNCE_SQL} AS bounce_rate FROM x"

ORACLE["monthly_active_users"] = """
WITH ud AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS a FROM events),
cal AS (SELECT CAST(unnest(generate_series(MIN(a), MAX(a), INTERVAL 1 DAY)) AS DATE) AS date FROM ud)
SELECT cal.date, COUNT(DISTINCT ud.user_id) AS mau
FROM cal LEFT JOIN ud ON ud.a BETWEEN cal.date - 29 AND cal.date
GROUP BY cal.date"""

# --- landed documents ---------------------------------------------------------------------

ORACLE["paged_json_scan"] = """
WITH x AS (SELECT c_mktsegment AS pipeline, o_totalprice AS amount,
             CASE WHEN o_orderkey % 3 IN (0, 1) THEN c_name ELSE '' END AS company
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT pipeline, COUNT(*) AS n_records, CAST(round(SUM(CAST(amount AS DECIMAL(38,9))), 2) AS DOUBLE) AS amount,
  COUNT(DISTINCT company) AS n_companies FROM x GROUP BY 1
UNION ALL
SELECT '*', COUNT(*), CAST(round(SUM(CAST(amount AS DECIMAL(38,9))), 2) AS DOUBLE), COUNT(DISTINCT company) FROM x"""

ORACLE["nested_property_sum"] = """
WITH x AS (
  SELECT l_returnflag AS status,
    CASE WHEN l_suppkey % 10 = 1 THEN NULL WHEN l_suppkey % 10 = 0 THEN -(l_quantity * 1000)
         ELSE l_quantity * 1000 END AS v,
    CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE -l_extendedprice END AS p
  FROM lineitem)
SELECT status, COUNT(*) AS n_pages, CAST(COUNT_IF(v > 0) AS BIGINT) AS value_pages,
  CAST(round(CAST(COALESCE(CAST(SUM(CASE WHEN v > 0 THEN CAST(v AS DECIMAL(38,9)) END) AS DOUBLE), 0.0) / 1e6
    AS DECIMAL(38,9)), 2) AS DOUBLE) AS total_gwh,
  COALESCE(CAST(round(SUM(CASE WHEN p > 0 THEN CAST(p AS DECIMAL(38,9)) END), 2) AS DOUBLE), 0.0) AS provision
FROM x GROUP BY 1"""

ORACLE["nested_array_sum"] = """
SELECT CAST(ts AS DATE) AS date, CAST(SUM(event_id % 50 + 1) AS BIGINT) AS impressions,
  CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(38,9)) END), 0)
       + CAST(COUNT_IF(event_type = 'click') AS BIGINT) + CAST(COUNT_IF(event_type = 'view') AS BIGINT) AS DOUBLE) AS views
FROM events GROUP BY 1"""

ORACLE["distinct_customers_nested"] = """
WITH ids AS (
  SELECT o_orderstatus AS status, 'cust-' || CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)
  UNION ALL SELECT o_orderstatus, 'rel-' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderstatus, 'rel-' || CAST(o_custkey % 50 AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 2
),
pg AS (SELECT o_orderstatus AS status, COUNT(*) AS n_pages,
         CAST(COUNT_IF(o_orderkey % 3 <> 0 AND o_totalprice > 0) AS BIGINT) AS value_positive FROM orders GROUP BY 1),
dc AS (SELECT status, COUNT(DISTINCT id) AS n_customers FROM ids GROUP BY 1)
SELECT pg.status, n_pages, COALESCE(n_customers, 0) AS n_customers, value_positive
FROM pg LEFT JOIN dc ON pg.status = dc.status"""

ORACLE["property_inventory"] = """
SELECT name, type, COUNT(*) AS n_pages FROM (
  SELECT ['JVP (kWh)', 'kWh p.a.', 'kWh', 'JVP'][l_linenumber % 4 + 1] AS name,
    CASE WHEN l_suppkey % 10 = 1 THEN 'rich_text' WHEN l_suppkey % 10 = 0 THEN 'number'
         WHEN l_partkey % 3 = 0 THEN 'number' WHEN l_partkey % 3 = 1 THEN 'formula' ELSE 'rollup' END AS type
  FROM lineitem
  UNION ALL SELECT 'Provision Gesamt', 'formula' FROM lineitem
  UNION ALL SELECT 'Status', 'select' FROM lineitem
  UNION ALL SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'kWh' ELSE 'Notiz' END,
                   CASE WHEN l_linenumber % 4 = 0 THEN 'number' ELSE 'rich_text' END FROM lineitem
) x GROUP BY 1, 2"""

ORACLE["first_data_source"] = """
SELECT 'db-' || CAST(p_partkey AS VARCHAR) AS id,
  CASE p_partkey % 4 WHEN 0 THEN 'ds-' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'dsx-' || CAST(p_partkey AS VARCHAR)
       WHEN 2 THEN 'ds2-' || CAST(p_partkey AS VARCHAR) END AS first_id
FROM part"""

# --- sinks, streaming, health, generator ----------------------------------------------------

ORACLE["snapshot_overwrite"] = with_ctes(L_CTE) + \
    "SELECT name, company, stage, status, amount, created_date, closing_date FROM l"

ORACLE["stream_refresh"] = ORACLE["monthly_rollup"]

ORACLE["load_health"] = with_ctes(D_CTE, MONTHLY_CTE, L_CTE, T_CTE, """
c AS (SELECT 'kpi_daily' AS table_name, COUNT(*) AS n FROM d
      UNION ALL SELECT 'kpi_monthly', COUNT(*) FROM m
      UNION ALL SELECT 'kpi_targets', COUNT(*) FROM t
      UNION ALL SELECT 'zoho_leads', COUNT(*) FROM l),
e AS (SELECT * FROM (VALUES ('kpi_daily', 1), ('kpi_monthly', 2), ('kpi_targets', 3), ('zoho_leads', 4),
      ('kpi_events', 5)) v(table_name, pos))""") + """
SELECT e.table_name, e.pos, c.n IS NOT NULL AS present, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_rows
FROM e LEFT JOIN c ON e.table_name = c.table_name"""


# tenants: the daily facts of every customer
TD_CTE = (D_CTE.replace("FROM o_ GROUP BY date", "FROM o_ GROUP BY o_custkey, date")
          .replace("SELECT date, COUNT(*) AS n,", "SELECT o_custkey AS tenant, date, COUNT(*) AS n,")
          .replace("SELECT date,\n", "SELECT tenant, date,\n").replace("\nd AS (", "\ntd AS ("))

ORACLE["tenant_monthly_rollup"] = with_ctes(TD_CTE, monthly_cte("td", "tenant", "tm")) + "SELECT * FROM tm"
ORACLE["tenant_stream_refresh"] = ORACLE["tenant_monthly_rollup"]

ORACLE["tenant_ytd_values"] = with_ctes(TD_CTE, """
yr AS (SELECT tenant, date, year(date) = 1998 AS inside, ga_visitors, notion_customers_total, notion_provision_eur, seq FROM td)""") + """
SELECT tenant, 'ga_visitors' AS kpi, 'sum' AS kind, CAST(COALESCE(SUM(ga_visitors) FILTER (WHERE inside), 0) AS DOUBLE) AS ytd
FROM yr GROUP BY 1
UNION ALL SELECT tenant, 'notion_customers_total', 'snapshot',
  CAST(COALESCE(arg_max(notion_customers_total, seq) FILTER (WHERE inside AND notion_customers_total > 0), 0) AS DOUBLE) FROM yr GROUP BY 1
UNION ALL SELECT tenant, 'notion_provision_eur', 'sum',
  CAST(COALESCE(SUM(CAST(notion_provision_eur AS DECIMAL(38,9))) FILTER (WHERE inside), 0) AS DOUBLE) FROM yr GROUP BY 1"""

ORACLE["upsert_replay"] = UPSERT_CTE + "SELECT date, " + ", ".join(
    f"COALESCE({k}, {_KPI_DEFAULT[k]}) AS {k}" for k in DAILY_KPIS) + ", seq, strftime(date, '%Y-%m') AS month FROM ul"

_DAILY_TEXT = {"date": "CASE WHEN day(date) = 11 THEN NULL ELSE date END",
               "ga_visitors": "CASE WHEN day(date) = 13 THEN 0 ELSE ga_visitors END",
               "li_views": "CASE WHEN day(date) IN (17, 19) THEN 0 ELSE li_views END"}
ORACLE["load_daily_text"] = with_ctes(D_CTE) + f"SELECT {_daily_select(_DAILY_TEXT)} FROM d"

ORACLE["load_monthly_text"] = with_ctes(D_CTE, MONTHLY_CTE) + "SELECT * FROM m"

ORACLE["load_targets_text"] = """
WITH t AS (SELECT p_partkey AS row_pos, trim(p_brand) AS kpi,
    CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(printf('%.2f', p_retailprice) AS DOUBLE) END AS target_yearly,
    'EUR' AS unit, p_type AS category FROM part)
SELECT row_pos, kpi, target_yearly, unit, category
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi ORDER BY row_pos) AS rn FROM t) x WHERE rn = 1"""

ORACLE["metric_report_by_kind"] = with_ctes(SESSIONS_CTE.replace("PARTITION BY user_id", "PARTITION BY event_type, user_id"), f"""
x AS (SELECT event_type, CAST(ts AS DATE) AS date, {_METRICS_SQL} FROM fl GROUP BY 1, 2)""") + \
    f"SELECT *, {_BOUNCE_SQL} AS bounce_rate FROM x"

ORACLE["bounce_from_engagement"] = with_ctes(SESSIONS_CTE, f"""
x AS (SELECT CAST(ts AS DATE) AS date, {_METRICS_SQL} FROM fl GROUP BY 1),
y AS (SELECT date, {_BOUNCE_SQL} AS b FROM x)""") + """
SELECT date, CASE WHEN day(date) % 2 = 0 THEN b END AS bounce,
  CASE WHEN day(date) % 2 = 0 THEN b ELSE 100.0 - (100.0 - b) END AS bounce_rate FROM y"""

ORACLE["active_users_scalar"] = """
SELECT CAST(ts AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors,
  (SELECT COUNT(DISTINCT user_id) FROM events
   WHERE CAST(ts AS DATE) > DATE '2024-01-31' - 30 AND CAST(ts AS DATE) <= DATE '2024-01-31') AS mau
FROM events GROUP BY 1"""

ORACLE["trailing_series_long"] = with_ctes(D_CTE, "w AS (SELECT * FROM d WHERE date >= (SELECT MAX(date) FROM d) - 90)") + """
SELECT date, 'ga_visitors' AS series, 'Besucher' AS label, CAST(ga_visitors AS DOUBLE) AS value FROM w
UNION ALL
SELECT date, 'ga_sessions' AS series, 'Sessions' AS label, CAST(ga_sessions AS DOUBLE) AS value FROM w"""

ORACLE["won_stage_counts_created"] = with_ctes(L_CTE) + f"""
SELECT stage, COUNT(*) AS deals FROM l WHERE stage IN {_in(WON_STAGES)}
  AND created_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' GROUP BY ROLLUP (stage)"""

ORACLE["lead_funnel_without_leads"] = with_ctes(D_CTE, """
lc AS (SELECT CAST(COALESCE(arg_max(zoho_deals_total, seq) FILTER (WHERE zoho_deals_total > 0), 0) AS BIGINT) AS total,
  CAST(0 AS BIGINT) AS "new", CAST(0 AS BIGINT) AS active, CAST(0 AS BIGINT) AS won, CAST(0 AS BIGINT) AS lost,
  CAST(0 AS BIGINT) AS waiting FROM d)""", "s AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS pos, {_q(label)} AS stage, \"{src}\" AS value FROM lc"
    for i, (label, src) in enumerate(FUNNEL_STAGES)) + ")") + """
SELECT pos, stage, value,
  CASE WHEN FIRST_VALUE(value) OVER (ORDER BY pos) > 0
       THEN CAST(value AS DOUBLE) / CAST(FIRST_VALUE(value) OVER (ORDER BY pos) AS DOUBLE) * 100 END AS pct_of_first
FROM s"""

ORACLE["kpis_collected"] = with_ctes(TD_CTE) + """
SELECT tenant, CAST(2 + CASE WHEN li_views > 0 THEN 1 ELSE 0 END AS INTEGER) AS kpis_collected
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant ORDER BY date DESC, seq DESC) AS rn FROM td) x WHERE rn = 1"""

ORACLE["gauge_edges"] = with_ctes(D_CTE, MONTHLY_CTE, """
g AS (SELECT month, ga_visitors_sum, CAST(ga_visitors_sum AS DOUBLE) / 120.0::DOUBLE * 100 AS pct FROM m)""") + """
SELECT month, ga_visitors_sum, pct, CASE WHEN pct >= 100 THEN 'success' WHEN pct >= 70 THEN 'warning' ELSE 'danger' END AS band,
  120.0::DOUBLE * 0.7::DOUBLE AS edge_warning, 120.0::DOUBLE AS edge_success, 120.0::DOUBLE * 1.2::DOUBLE AS edge_max FROM g"""

ORACLE["tagged_values"] = """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 13 AS INTEGER) AS kind, o_totalprice, o_orderpriority,
             't-' || CAST(o_orderkey AS VARCHAR) AS t FROM orders)
SELECT o_orderkey, kind, CASE
  WHEN kind IN (1, 2) THEN t WHEN kind IN (3, 4) THEN o_orderpriority
  WHEN kind IN (0, 5, 6) THEN CAST(o_totalprice AS VARCHAR)
  WHEN kind = 7 THEN '2024-01-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR)
  WHEN kind = 8 THEN CASE WHEN o_orderkey % 2 = 0 THEN '2 Verknüpfung(en)' ELSE '0' END
  WHEN kind = 9 THEN '{"type":"string","string":"' || t || '"}'
  WHEN kind = 10 THEN '{"type":"boolean","boolean":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'
  WHEN kind = 11 THEN '{"type":"date","date":{"start":"2024-02-03"}}'
  ELSE '(people)' END AS value FROM o"""

ORACLE["stats_interval"] = ORACLE["nested_array_sum"].replace(
    "FROM events", "FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-08' AND CAST(ts AS DATE) < DATE '2024-01-22'")

ORACLE["picklist_values"] = """
SELECT DISTINCT p_brand AS api_name, p_type AS display_label, 'picklist' AS data_type,
  'Size ' || CAST(p_size AS VARCHAR) AS display_value, CAST(p_size AS VARCHAR) AS actual_value
FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')"""

ORACLE["stream_event_windows"] = """
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS events, CAST(COUNT_IF(event_type = 'view') AS BIGINT) AS pageviews,
  CAST(COUNT_IF(event_type = 'purchase') AS BIGINT) AS purchases,
  COALESCE(CAST(round(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(38,9)) END), 2) AS DOUBLE),
           0.0) AS purchase_value
FROM events GROUP BY 1"""

_T_NULLED = "CASE WHEN tenant % 2 = 0 THEN NULL ELSE li_views END"
ORACLE["tenant_upsert"] = with_ctes(TD_CTE, f"""
ex AS (
  SELECT tenant, {_daily_select({})} FROM td WHERE (tenant + day(date)) % 4 <> 0
  UNION ALL
  SELECT tenant, {_daily_select({'ga_visitors': 'ga_visitors + 1', 'seq': 'seq + 1000000'})}
  FROM td WHERE (tenant + day(date)) % 4 <> 0 AND tenant % 7 = 0
),
up AS (
  SELECT tenant, {_daily_select({'ga_visitors': 'ga_visitors * 2', 'li_views': _T_NULLED, 'seq': 'seq + 2000000'})}
  FROM td WHERE (tenant + day(date)) % 2 = 0
),
ef AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant, date ORDER BY seq) AS rn FROM ex) x
       WHERE rn = 1)""") + "SELECT up.tenant, up.date, " + ", ".join(
    f"COALESCE(up.{k}, ef.{k}, {_KPI_DEFAULT[k]}) AS {k}" for k in DAILY_KPIS) + """, up.seq
FROM up LEFT JOIN ef ON up.tenant = ef.tenant AND up.date = ef.date
UNION ALL
SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.tenant = ex.tenant AND up.date = ex.date)"""

# --- streams with state, landed page chains -------------------------------------------------

ORACLE["stream_sessions"] = ORACLE["metric_report_daily"]
ORACLE["stream_unique_events"] = ORACLE["stream_event_windows"]

CRM_CHAIN_CTE = with_ctes("""
x AS (SELECT o_orderkey // 200 AS page, c_mktsegment AS pipeline, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT MAX(o_orderkey // 200) AS m FROM orders),
p AS (SELECT DISTINCT page FROM x),
k AS (SELECT page FROM p, m WHERE page % 7 <> 3 OR page = m)""")

ORACLE["crm_chain_records"] = CRM_CHAIN_CTE + """
SELECT pipeline, COUNT(*) AS n_records, CAST(round(SUM(CAST(amount AS DECIMAL(38,9))), 2) AS DOUBLE) AS amount
FROM x WHERE page IN (SELECT page FROM k) GROUP BY 1"""

ORACLE["crm_chain_report"] = CRM_CHAIN_CTE + """
SELECT CAST((SELECT COUNT(*) + COUNT_IF(page % 5 = 0) FROM k) + (SELECT COUNT(*) FROM p WHERE page < 3) AS BIGINT) AS landed,
  (SELECT CAST(COUNT_IF(page % 5 = 0) AS BIGINT) FROM k) AS repeated,
  (SELECT COUNT(*) FROM p WHERE page < 3) AS after_end,
  (SELECT m + 1 - (SELECT COUNT(*) FROM k) FROM m) AS missing,
  (SELECT m + 1 = (SELECT COUNT(*) FROM k) FROM m) AS complete,
  (SELECT COUNT(*) FROM x WHERE page IN (SELECT page FROM k)) AS records, (SELECT COUNT(*) FROM k) AS pages"""

ORACLE["crm_missing_pages"] = CRM_CHAIN_CTE + """,
g AS (SELECT page, page - row_number() OVER (ORDER BY page) AS island
      FROM (SELECT unnest(generate_series(0, (SELECT m FROM m))) AS page) s WHERE page NOT IN (SELECT page FROM k))
SELECT MIN(page) AS from_page, MAX(page) AS to_page FROM g GROUP BY island"""

ORACLE["cursor_chain_report"] = """
WITH l AS (SELECT l_orderkey // 25 AS grp, COUNT(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT MAX(grp) AS top, MAX(grp) // 2 AS mid FROM l),
r AS (SELECT 'a' AS run, grp, n FROM l, t WHERE grp <= mid
      UNION ALL SELECT 'b', grp, n FROM l, t WHERE grp > mid AND (grp % 11 <> 5 OR grp = mid + 1 OR grp = top)),
f AS (SELECT r.*, top, mid, lead(grp) OVER (PARTITION BY run ORDER BY grp) AS following FROM r, t),
c AS (SELECT run, COUNT(*) AS n, COUNT_IF(grp % 9 = 4 AND run = 'a') AS twice, COUNT_IF(grp < 3 AND run = 'a') AS stray,
        COUNT_IF(following > grp + 1) AS breaks, SUM(n) AS results FROM f GROUP BY run)
SELECT run, CAST(n + twice + stray AS BIGINT) AS landed, CAST(twice AS BIGINT) AS repeated, CAST(stray AS BIGINT) AS after_end,
  CAST(breaks AS BIGINT) AS missing, breaks = 0 AS complete, CAST(results AS BIGINT) AS results FROM c"""

ORACLE["load_leads_text"] = with_ctes(L_CTE) + """
SELECT status, CASE WHEN lead_id % 13 = 0 THEN NULL ELSE strftime(closing_date, '%Y-%m') END AS month, COUNT(*) AS n,
  CAST(COUNT_IF(lead_id % 11 <> 0) AS BIGINT) AS with_amount,
  CAST(round(SUM(CASE WHEN lead_id % 11 <> 0 THEN CAST(amount AS DECIMAL(38,9)) END), 2) AS DOUBLE) AS amount
FROM l GROUP BY 1, 2"""

ORACLE["late_days_rollup"] = ORACLE["monthly_rollup"]
ORACLE["tenant_late_days_rollup"] = ORACLE["tenant_monthly_rollup"]

ORACLE["stream_lead_status"] = ORACLE["lead_status_counts"]

_EX_LAST = "(tenant % 7 = 0)"      # the stored copy of these tenants is the later one
ORACLE["bucketed_upsert"] = with_ctes(TD_CTE, f"""
ex AS (SELECT tenant, {_daily_select({'ga_visitors': f'ga_visitors + CASE WHEN {_EX_LAST} THEN 1 ELSE 0 END',
                                      'seq': f'seq + CASE WHEN {_EX_LAST} THEN 1000000 ELSE 0 END'})}
       FROM td WHERE (tenant + day(date)) % 4 <> 0),
up AS (SELECT tenant, {_daily_select({'ga_visitors': 'ga_visitors * 2', 'li_views': _T_NULLED, 'seq': 'seq + 2000000'})}
       FROM td WHERE (tenant + day(date)) % 2 = 0)""") + "SELECT up.tenant, up.date, " + ", ".join(
    f"COALESCE(up.{k}, ex.{k}, {_KPI_DEFAULT[k]}) AS {k}" for k in DAILY_KPIS) + """, up.seq
FROM up LEFT JOIN ex ON up.tenant = ex.tenant AND up.date = ex.date
UNION ALL
SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.tenant = ex.tenant AND up.date = ex.date)"""

# --- footers of stored tables ------------------------------------------------------------

ORACLE["source_health"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, MIN({k}) AS key_min, MAX({k}) AS key_max, COUNT({v}) AS n_values FROM {t}"
    for t, k, v in [("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_mktsegment"),
                    ("lineitem", "l_orderkey", "l_shipdate"), ("events", "event_id", "user_id")])

ORACLE["stored_health"] = with_ctes(D_CTE, L_CTE) + """
SELECT 'kpi_daily' AS table_name, 1 AS pos, TRUE AS present, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date FROM d
UNION ALL SELECT 'zoho_leads', 2, TRUE, COUNT(*), NULL, NULL FROM l
UNION ALL SELECT 'kpi_events', 3, FALSE, 0, NULL, NULL"""

ORACLE["tenant_month_stats"] = with_ctes(TD_CTE) + """
SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS n_rows, MIN(date) AS date_min, MAX(date) AS date_max,
  COUNT(ga_visitors) AS ga_visitors_n, COUNT(notion_provision_eur) AS notion_provision_eur_n
FROM td GROUP BY 1"""

ORACLE["months_with_gaps"] = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) % 11 <> 0 OR month(o_orderdate) % 2 = 0),
c AS (SELECT CAST(unnest(generate_series(date_trunc('month', MIN(date)), MAX(date), INTERVAL 1 MONTH)) AS DATE) AS first FROM d),
n AS (SELECT first, (SELECT COUNT(*) FROM d WHERE date_trunc('month', d.date) = c.first) AS days FROM c)
SELECT strftime(first, '%Y-%m') AS month, days, day(last_day(first)) - days AS missing
FROM n WHERE day(last_day(first)) > days"""

# --- stored distinct-count sketches: the exact counts; every estimate is within its bound ------

ORACLE["approx_monthly_active_users"] = f"SELECT date, mau, TRUE AS within_bound FROM ({ORACLE['monthly_active_users']}) x"

ORACLE["approx_active_users_by_kind"] = """
WITH ud AS (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS a FROM events WHERE user_id IS NOT NULL),
cal AS (SELECT event_type, CAST(unnest(generate_series(MIN(a), MAX(a), INTERVAL 1 DAY)) AS DATE) AS date FROM ud GROUP BY 1)
SELECT cal.event_type, cal.date, COUNT(DISTINCT ud.user_id) AS wau, TRUE AS within_bound
FROM cal LEFT JOIN ud ON ud.event_type = cal.event_type AND ud.a BETWEEN cal.date - 6 AND cal.date
GROUP BY 1, 2"""

ORACLE["approx_customers_by_month"] = """
SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS month, COUNT(DISTINCT o_custkey) AS n_customers, TRUE AS within_bound
FROM orders GROUP BY 1, 2"""
