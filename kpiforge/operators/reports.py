"""Report datasets (RPT-1, RPT-2, AGG-16): long-form series and one-row KPI cards.

Charts are not drawn here; these frames are what any charting tool needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum, pct_change, round_half_up
from .rollup import last_known, order_key


def series_long(df: DataFrame, x: str, cols: Sequence[str], labels: Mapping[str, str] | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """RPT-1: wide series -> ``(x, series, label, value DOUBLE)``; the label
    defaults to the column name. The label lookup is a literal map
    expression, so no join is needed."""
    labels = dict(labels or {})
    long = df.select(*by, x, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*by, x], list(cols), "series", "value")
    if labels:
        m = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
        label = F.coalesce(m[F.col("series")], F.col("series"))
    else:
        label = F.col("series")
    return long.select(*by, x, "series", label.alias("label"), "value")


def kpi_cards(daily: DataFrame, leads: DataFrame | None, days: int = 30, by: Sequence[str] = (),
              date_col: str = "date") -> DataFrame:
    """RPT-2: the seven dashboard values and their deltas in one row per group.

    Period sums take the last ``days`` rows inside the window
    ``date >= max(date) - days``; the previous period is the ``days`` rows
    before them in the unfiltered table (SURVEY Q4). Snapshot values are
    the last known (> 0) value inside the window; the customer delta is
    against the known value before it.
    """
    by = list(by)
    order = [F.col(date_col).desc()] + ([F.col("seq").desc()] if "seq" in daily.columns else [])
    w_all = Window.partitionBy(*by)
    r = daily.select(
        "*",
        F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_rn"),
        F.max(date_col).over(w_all).alias("_maxd"),
        F.count(F.lit(1)).over(w_all).alias("_rows"),
    )
    r = r.withColumn("_win", F.col(date_col) >= F.date_sub("_maxd", days))
    # rank of known customer rows inside the window (1 = latest, 2 = the one before)
    flag = F.col("_win") & (F.col("notion_customers_total") > 0)
    r = r.withColumn("_crk", F.row_number().over(Window.partitionBy(*by, flag).orderBy(*order)))
    rn, win = F.col("_rn"), F.col("_win")
    period = (rn <= days) & win
    prev = (rn > days) & (rn <= 2 * days)
    o = order_key(daily, date_col)
    cust_known = win & (F.col("notion_customers_total") > 0)

    def known_in_win(c):
        return last_known(c, o, win & (F.col(c) > 0))

    a = r.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(period, F.col("ga_visitors"))), F.lit(0)).cast("bigint").alias("visitors"),
        F.when(F.max("_rows") >= 2 * days, F.coalesce(F.sum(F.when(prev, F.col("ga_visitors"))), F.lit(0)))
         .otherwise(F.lit(0)).cast("bigint").alias("visitors_prev"),
        F.coalesce(F.sum(F.when(period, F.col("li_impressions"))), F.lit(0)).cast("bigint").alias("impressions"),
        F.when(F.max("_rows") >= 2 * days, F.coalesce(F.sum(F.when(prev, F.col("li_impressions"))), F.lit(0)))
         .otherwise(F.lit(0)).cast("bigint").alias("impressions_prev"),
        F.coalesce(F.max_by("notion_customers_total", F.when(cust_known & (F.col("_crk") == 1), o)), F.lit(0))
         .cast("bigint").alias("customers"),
        F.coalesce(F.max_by("notion_customers_total", F.when(cust_known & (F.col("_crk") == 2), o)), F.lit(0))
         .cast("bigint").alias("customers_prev"),
        F.coalesce(known_in_win("notion_yearly_consumption_gwh"), F.lit(0.0)).alias("gwh"),
        F.coalesce(round_half_up(known_in_win("notion_provision_eur"), 0), F.lit(0.0)).alias("provision"),
        F.coalesce(exact_sum(F.when(period, F.col("manual_license_revenue")), 0), F.lit(0.0)).alias("license"),
        F.coalesce(known_in_win("auth0_mau"), F.lit(0)).cast("bigint").alias("mau"),
    )
    a = a.select(
        "*",
        pct_change("visitors", "visitors_prev").alias("visitors_delta_pct"),
        pct_change("impressions", "impressions_prev").alias("impressions_delta_pct"),
        F.when(F.col("customers_prev") > 0, F.col("customers") - F.col("customers_prev")).alias("customers_delta"),
    )
    if leads is None:
        return a.select("*", F.lit(0).cast("bigint").alias("active_leads"),
                        F.lit(0).cast("bigint").alias("new_leads"))
    lc = leads.groupBy(*by).agg(F.count_if(F.col("status").isin("new", "active")).alias("active_leads"),
                                F.count_if(F.col("status") == "new").alias("new_leads"))
    if not by:
        # one scalar subquery (both counts in a struct): the lead scan runs once
        c = lc.select(F.struct("active_leads", "new_leads").alias("c")).scalar()
        return a.select("*", F.coalesce(c.getField("active_leads"), F.lit(0)).alias("active_leads"),
                        F.coalesce(c.getField("new_leads"), F.lit(0)).alias("new_leads"))
    j = a.join(lc, by, "left")
    return j.fillna(0, ["active_leads", "new_leads"])


def table_counts(frames: Mapping[str, DataFrame | None], expected: Sequence[str]) -> DataFrame:
    """AGG-16: expected tables with presence flag and row count.

    One ``count(*)`` aggregate per present table, unioned (each a single
    row), then matched against the expected names.
    """
    present = [(n, f) for n, f in frames.items() if f is not None]
    if not present:
        raise ValueError("no tables")
    spark = present[0][1].sparkSession
    parts = [f.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, f in present]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    exp = spark.createDataFrame([(n, i + 1) for i, n in enumerate(expected)], "table_name string, pos int")
    return (exp.join(counts, "table_name", "left")
            .select("table_name", "pos", F.col("n_rows").isNotNull().alias("present"),
                    F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


def kpis_collected(daily: DataFrame, kpis: Sequence[str], date_col: str = "date",
                   by: Sequence[str] = ()) -> DataFrame:
    """AGG-16: number of non-NULL KPI values on the latest row of each group."""
    o = order_key(daily, date_col)
    n = sum((F.col(k).isNotNull().cast("int") for k in kpis), F.lit(0))
    return daily.groupBy(*by).agg(F.max_by(n, o).alias("kpis_collected"))
