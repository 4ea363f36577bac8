"""Lead pipeline operators (AGG-8, AGG-9, AGG-15, RPT-3, RPT-4, ORD-4, FLT-5, FLT-7).

Counts are one pass of filtered counts (``count_if``) that combine map-side;
lists are filters and projections; the funnel is a six-row frame built from
the one-row counts with ``stack``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date_lit
from ..functions.text import full_name
from ..schemas import FUNNEL_STAGES, LEAD_DISPLAY_LABELS, LEAD_STATUSES, WON_STAGES
from .windows import pct_of_first


def status_counts(leads: DataFrame, by: Sequence[str] = (), status_col: str = "status") -> DataFrame:
    """AGG-8 + AGG-9: total and per-status counts in one row (absent status -> 0)."""
    s = F.col(status_col)
    return leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == st).alias(st) for st in LEAD_STATUSES],
    )


def lead_funnel(leads: DataFrame | None, daily: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """RPT-3 + WIN-8: the six funnel stages with their percent of the first.

    Without a lead table the total falls back to the last known daily
    ``zoho_deals_total`` and every other stage is 0.
    """
    by = list(by)
    if leads is not None:
        counts = status_counts(leads, by)
    else:
        if daily is None:
            raise ValueError("need leads or daily facts")
        from .rollup import last_known, order_key
        counts = daily.groupBy(*by).agg(
            F.coalesce(last_known("zoho_deals_total", order_key(daily)), F.lit(0)).cast("bigint").alias("total"))
        counts = counts.select(*by, "total", *[F.lit(0).cast("bigint").alias(s) for s in LEAD_STATUSES])
    pairs = ", ".join(f"{i + 1}, '{label}', `{src}`" for i, (label, src) in enumerate(FUNNEL_STAGES))
    stacked = counts.selectExpr(*[f"`{b}`" for b in by], f"stack({len(FUNNEL_STAGES)}, {pairs}) AS (pos, stage, value)")
    return stacked.withColumn("pct_of_first", pct_of_first("value", "pos", by))


def lead_lists(leads: DataFrame, statuses: Sequence[str] = ("new", "active"), by: Sequence[str] = ()) -> DataFrame:
    """RPT-4 + FLT-5 + PRJ-1: leads of the listed statuses with display names and
    the list size. Sizes come from a grouped count joined back on the status
    (at most one row per listed status and group)."""
    by = list(by)
    sel = leads.where(F.col("status").isin(*statuses))
    sizes = sel.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("list_size"))
    shown = sel.select(*by, "status", *[F.col(src).alias(dst) for src, dst in LEAD_DISPLAY_LABELS])
    # without groups, ``sizes`` has at most len(statuses) rows: safe to broadcast
    return shown.join(F.broadcast(sizes) if not by else sizes, [*by, "status"], "inner")


def won_stage_counts(leads: DataFrame, stages: Sequence[str] = WON_STAGES, created_from=None,
                     created_to=None) -> DataFrame:
    """AGG-15 + FLT-7: count per won stage plus a total row (stage NULL), via
    ``rollup``; optional inclusive created-date range."""
    f = leads.where(F.col("stage").isin(*stages))
    if created_from is not None:
        f = f.where(F.col("created_date") >= as_date_lit(created_from))
    if created_to is not None:
        f = f.where(F.col("created_date") <= as_date_lit(created_to))
    return f.rollup("stage").agg(F.count(F.lit(1)).alias("deals"))


def newest_leads(leads: DataFrame, n: int = 5, key: str = "lead_id") -> DataFrame:
    """ORD-4/ORD-5 + SCL-11: the ``n`` newest leads (ties broken by key),
    planned as TakeOrderedAndProject (a per-partition top-n, then a merge)."""
    return (leads.orderBy(F.col("created_date").desc(), F.col(key).asc()).limit(n)
            .select(key, "name", "company", "stage", "created_date",
                    full_name("name", "company").alias("display_name")))
