"""Year-to-date values against targets (AGG-14, JON-2/3/6/7, SCL-20..23, RPT-5, RPT-6).

The daily table is scanned once for all KPIs: one aggregation computes a
year sum and a last known value per KPI side by side (wide), and the result
is turned long by exploding an in-row array. Targets, KPI metadata and the
scoreboard layout are tiny literal or user tables joined to a result of at
most one row per KPI and group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date_lit, in_year, year_progress
from ..functions.numbers import exact_sum
from ..functions.status import attainment_band, attainment_pct, month_share, on_track_status, progress_record
from ..schemas import (DAILY_KPIS, DOUBLE_KPIS, LEAD_COUNT_KPIS, MONTHLY_COLUMN_MAP, SCOREBOARD_LAYOUT, SNAPSHOT_KPIS,
                       kpi_meta)
from .rollup import last_known, order_key
from .windows import first_per_key


def kpi_kind(kpi: str) -> str:
    if kpi in SNAPSHOT_KPIS:
        return "snapshot"
    if kpi in LEAD_COUNT_KPIS:
        return "lead_count"
    return "sum"


def ytd_values(daily: DataFrame, leads: DataFrame | None, year: int, kpis: Sequence[str] | None = None,
               by: Sequence[str] = (), date_col: str = "date") -> DataFrame:
    """AGG-14: year-to-date value per KPI kind.

    snapshot -> last known (> 0) value in the year; lead_count -> number of
    all leads (AGG-9, as the reference does); sum -> year sum. A year without
    rows gives 0, for every group that has rows in any year. Output
    ``(by..., kpi, kind, ytd DOUBLE)``.

    Without groups the year is a filter that prunes the scan; with groups it is
    a condition inside the aggregates, so that no group is lost in one scan.
    """
    by = list(by)
    kpis = [k for k in (kpis or DAILY_KPIS) if k in daily.columns or kpi_kind(k) == "lead_count"]
    inside = in_year(F.col(date_col), year)
    y = daily if by else daily.where(inside)
    o = order_key(daily, date_col)

    def of_year(k: str):
        return F.when(inside, F.col(k)) if by else F.col(k)

    aggs = []
    for k in kpis:
        kind = kpi_kind(k)
        if kind == "snapshot":
            aggs.append(last_known(of_year(k), o).cast("double").alias(k))
        elif kind == "sum":
            aggs.append((exact_sum(of_year(k)) if k in DOUBLE_KPIS else F.sum(of_year(k)).cast("double")).alias(k))
    wide = y.groupBy(*by).agg(*aggs) if aggs else y.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    lead_kpis = [k for k in kpis if kpi_kind(k) == "lead_count"]
    if lead_kpis:
        if leads is None:
            n_leads = F.lit(0.0)
        elif not by:
            n_leads = leads.agg(F.count(F.lit(1)).cast("double").alias("n")).select("n").scalar()
        else:
            lc = leads.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_leads"))
            wide = wide.join(lc, by, "left")
            n_leads = F.col("_leads")
        wide = wide.select("*", *[n_leads.alias(k) for k in lead_kpis])
    items = [F.struct(F.lit(k).alias("kpi"), F.lit(kpi_kind(k)).alias("kind"),
                      F.coalesce(F.col(k), F.lit(0.0)).alias("ytd")) for k in kpis]
    return wide.select(*by, F.explode(F.array(*items)).alias("_x")).select(*by, "_x.*")


def first_targets(targets: DataFrame, order: str = "row_pos") -> DataFrame:
    """WIN-7 / JON-2: first target row per KPI, by the column ``order``."""
    if order not in targets.columns:
        raise ValueError(f"targets need the order column {order!r}")
    return first_per_key(targets, ["kpi"], order)


def layout_frame(spark, layout=SCOREBOARD_LAYOUT) -> DataFrame:
    return spark.createDataFrame(list(layout), "grp string, pos int, kpi string")


def target_scoreboard(daily: DataFrame, leads: DataFrame | None, targets: DataFrame, as_of,
                      layout=SCOREBOARD_LAYOUT, by: Sequence[str] = ()) -> DataFrame:
    """RPT-5: KPIs of the fixed layout with ytd, target, prorated target,
    on-track status and attainment band.

    KPIs without a target are skipped (inner join); the first target row per
    KPI wins; labels fall back to the KPI id.
    """
    by = list(by)
    spark = daily.sparkSession
    as_of_d = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    lay = F.broadcast(layout_frame(spark, layout))  # fixed six rows
    meta = F.broadcast(kpi_meta(spark).select("kpi", "label"))  # fixed sixteen rows
    kpis = [k for _g, _p, k in layout]
    ytd = ytd_values(daily, leads, as_of_d.year, kpis, by)
    tf = first_targets(targets).select("kpi", "target_yearly", "unit")
    progress = year_progress(as_of_date_col(as_of_d))
    j = ytd.join(lay, "kpi").join(tf, "kpi").join(meta, "kpi", "left")
    target = F.col("target_yearly")
    due = target * progress
    pct = attainment_pct("ytd", target)
    return j.select(
        *by, "grp", "pos", "kpi", F.coalesce("label", "kpi").alias("label"), "unit", "ytd",
        target.alias("target"), progress.alias("year_progress"), due.alias("prorated_target"),
        pct.alias("pct"), on_track_status("ytd", target, progress).alias("status"),
        attainment_band(pct).alias("band"),
    )


def as_of_date_col(d: dt.date):
    return as_date_lit(d)


def progress_records(scoreboard: DataFrame, cap: float = 120.0) -> DataFrame:
    """SCL-22 over a scoreboard: ``value, target, percentage <= cap, band``."""
    keep = [c for c in scoreboard.columns if c in ("grp", "pos", "kpi")]
    return scoreboard.select(*keep, progress_record("ytd", "target", cap).alias("rec")).select(*keep, "rec.*")


def month_vs_target(monthly: DataFrame, targets: DataFrame, column_map=None, by: Sequence[str] = ()) -> DataFrame:
    """RPT-6 + PRJ-2/3 + JON-3 + SCL-23: monthly actual against 1/12 of the
    yearly target, for every KPI that has a target and a monthly column.

    The KPI -> monthly column lookup is a literal map with identity default
    (the new-deal KPI maps to its month-end snapshot column); the monthly
    table is unpivoted and joined with the first target rows on that column.
    """
    by = list(by)
    cmap = dict(MONTHLY_COLUMN_MAP if column_map is None else column_map)
    cmap.setdefault("zoho_deals_new", "zoho_deals_new_end")
    m = F.create_map(*[F.lit(v) for kv in cmap.items() for v in kv])
    tf = first_targets(targets).select("kpi", "target_yearly")
    tf = tf.select("kpi", F.coalesce(m[F.col("kpi")], F.col("kpi")).alias("mcol"),
                   month_share("target_yearly").alias("target_month"))
    value_cols = [c for c in monthly.columns if c not in ("month", *by)]
    long = monthly.select(*by, "month", *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        [*by, "month"], value_cols, "mcol", "actual")
    return long.join(tf, "mcol").select(*by, "kpi", "month", "actual", "target_month")
