"""Monthly rollups and their aggregate building blocks (AGG-1..7, WIN-5, WIN-6).

Everything is one ``groupBy(by + month).agg(...)`` with filtered
``max_by``/``min_by`` aggregates: they combine map-side (partial
aggregation), so a month or tenant holding a third of all rows is reduced
before the shuffle. No global sort is needed for "last row" semantics: the
order key ``(date, seq)`` is carried inside the aggregate, packed into one number so
that these are hash aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_key
from ..functions.numbers import exact_sum, round_half_up
from ..schemas import DAILY_SCHEMA, with_missing


#: Deal counts by status in the daily facts, in display order.
DEAL_STATES = ("new", "active", "won", "lost", "waiting")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(df: DataFrame, date_col: str = "date", seq_col: str = "seq") -> Column:
    """ORD-1: the row order used for "last" semantics: ``(date, seq)``, NULL first.

    Dates with whole-number ``seq`` are packed into one DECIMAL, which a hash
    aggregation can hold in place; a struct would make every "last row" a sort
    on both sides of the shuffle. Other types keep the struct.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    dated, seq = isinstance(types.get(date_col), T.DateType), types.get(seq_col)
    if not dated or not isinstance(seq, (*whole, type(None))):
        return F.struct(F.col(date_col), F.col(seq_col)) if seq is not None else F.struct(F.col(date_col))
    # both parts start at 1, so 0 is left for NULL; a day is worth more than any seq
    day = F.coalesce(F.unix_date(F.col(date_col)).cast("decimal(11,0)") + F.lit(Decimal(1 + (1 << 31))), F.lit(0))
    key = (day.cast("decimal(11,0)") * F.lit(Decimal(1 << 65))).cast("decimal(33,0)")
    if seq is None:
        return key
    part = F.coalesce(F.col(seq_col).cast("decimal(20,0)") + F.lit(Decimal(1 + (1 << 63))), F.lit(0))
    return (key + part.cast("decimal(21,0)")).cast("decimal(34,0)")


def last_known(x, order: Column, known: Column | None = None) -> Column:
    """AGG-3: value of ``x`` on the last row (by ``order``) where ``known``
    holds (default ``x > 0``); NULL when no row qualifies."""
    xc = _c(x)
    cond = (xc > 0) if known is None else known
    return F.max_by(xc, F.when(cond, order))


def gated_last(x, gate, order: Column) -> Column:
    """AGG-4: ``x`` from the last row where ``gate > 0``, even if ``x`` is 0 there."""
    return F.max_by(_c(x), F.when(_c(gate) > 0, order))


def last_non_null(x, order: Column) -> Column:
    """Last non-NULL value (pandas ``last``)."""
    xc = _c(x)
    return F.max_by(xc, F.when(xc.isNotNull(), order))


def first_non_null(x, order: Column) -> Column:
    xc = _c(x)
    return F.min_by(xc, F.when(xc.isNotNull(), order))


def trunc_mean(x) -> Column:
    """AGG-2: mean truncated toward zero, as BIGINT."""
    return F.avg(_c(x)).cast("bigint")


def new_since_previous(end_col: str, by: Sequence[str], order_col: str) -> Column:
    """WIN-5: ``greatest(0, end - last known end of any earlier period)``.

    No known end in the period -> 0; first known period -> its end. The
    window runs over the rolled-up table (one row per period and group), so
    its partitions hold at most one row per period.
    """
    w = Window.partitionBy(*by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col(end_col)
    prev = F.last(end, ignorenulls=True).over(w)
    return (F.when(end.isNull(), F.lit(0))
            .when(prev.isNull(), end)
            .otherwise(F.greatest(F.lit(0), end - prev))).cast("bigint")


def month_partials(daily: DataFrame, by: Sequence[str] = (), date_col: str = "date", known=None) -> DataFrame:
    """AGG-6 without what depends on other months: one row per (``by``, month).

    Sums and counts, the last known value of each snapshot KPI and the largest
    MAU, all from the month's own rows. Stored, these rows let a late day be
    applied by rewriting its own month's row (``streaming.refresh``).
    """
    by = list(by)
    d = with_missing(daily, DAILY_SCHEMA).withColumn("month", month_key(F.col(date_col)))
    o = order_key(d, date_col)
    cust = F.col("notion_customers_total")
    known = known or (lambda c: F.col(c) > 0)

    def end(c):
        return last_known(c, o, known(c))

    return d.groupBy(*by, "month").agg(
        F.sum("ga_visitors").cast("bigint").alias("visitors_sum"),
        trunc_mean("ga_visitors").alias("visitors_avg"),
        end("notion_customers_total").cast("bigint").alias("customers_end"),
        round_half_up(gated_last("notion_yearly_consumption_gwh", cust, o), 2).alias("gwh"),
        round_half_up(gated_last("notion_provision_eur", cust, o), 2).alias("provision"),
        exact_sum("manual_license_revenue", 2).alias("licenses"),
        end("zoho_deals_total").cast("bigint").alias("total_end"),
        *[end(f"zoho_deals_{s}").cast("bigint").alias(f"{s}_end") for s in DEAL_STATES],
        F.max("auth0_mau").cast("bigint").alias("mau"),
        F.sum("li_impressions").cast("bigint").alias("impressions_sum"),
        F.sum("li_views").cast("bigint").alias("views_sum"),
    )


def monthly_from_partials(partials: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """AGG-6 from ``month_partials``: new customers against the last known earlier month (WIN-5) and defaults.
    ``keep``: further columns of the partials that pass through."""
    by = list(by)
    return partials.select(
        *by,
        "month",
        *keep,
        F.col("visitors_sum").alias("ga_visitors_sum"),
        F.col("visitors_avg").alias("ga_visitors_avg"),
        F.coalesce("customers_end", F.lit(0)).cast("bigint").alias("notion_customers_end"),
        new_since_previous("customers_end", by, "month").alias("notion_customers_new"),
        F.coalesce("gwh", F.lit(0.0)).alias("notion_yearly_consumption_gwh"),
        F.coalesce("provision", F.lit(0.0)).alias("notion_provision_eur"),
        F.coalesce("licenses", F.lit(0.0)).alias("manual_license_revenue"),
        F.coalesce("total_end", F.lit(0)).cast("bigint").alias("zoho_deals_total_end"),
        *[F.coalesce(f"{s}_end", F.lit(0)).cast("bigint").alias(f"zoho_deals_{s}_end") for s in DEAL_STATES],
        F.coalesce("mau", F.lit(0)).cast("bigint").alias("auth0_mau_end"),
        F.coalesce("impressions_sum", F.lit(0)).alias("li_impressions_sum"),
        F.coalesce("views_sum", F.lit(0)).alias("li_views_sum"),
    )


def monthly_rollup(daily: DataFrame, by: Sequence[str] = (), date_col: str = "date",
                   month: str | None = None, known=None, seed: DataFrame | None = None) -> DataFrame:
    """AGG-6: daily facts -> one row per month (and per ``by`` group).

    Sums (visitors, impressions, views), truncated mean of visitors, last
    known snapshot values (``> 0``), gwh and provision gated by the last row
    with customers, license revenue sum, max of MAU and new customers against
    the last known earlier month. ``month='yyyy-MM'`` restricts the output
    to one month (the reference's current-month behaviour); new customers
    still look at every earlier month.

    ``seed`` (columns ``by..., month, notion_customers_end``) supplies known
    month ends from before the daily rows, e.g. of a stored monthly table.
    """
    partials = month_partials(daily, by, date_col, known)
    if seed is None:
        out = monthly_from_partials(partials, by)
    else:
        ends = seed.where(F.col("notion_customers_end") > 0).select(
            *by, "month", F.col("notion_customers_end").cast("bigint").alias("customers_end"), F.lit(True).alias("_seed"))
        both = partials.withColumn("_seed", F.lit(False)).unionByName(ends, allowMissingColumns=True)
        out = monthly_from_partials(both, by, ["_seed"]).where(~F.col("_seed")).drop("_seed")
    return out.where(F.col("month") == month) if month is not None else out


def monthly_rollup_variant(daily: DataFrame, by: Sequence[str] = (), date_col: str = "date") -> DataFrame:
    """AGG-7 / WIN-6: the alternative rollup: sum, half-even rounded mean,
    last non-null, last minus first, sums of daily new and won deals."""
    by = list(by)
    d = with_missing(daily, DAILY_SCHEMA).withColumn("month", month_key(F.col(date_col)))
    o = order_key(d, date_col)
    cust = "notion_customers_total"
    return d.groupBy(*by, "month").agg(
        F.sum("ga_visitors").cast("bigint").alias("ga_visitors_sum"),
        F.bround(F.avg("ga_visitors"), 0).cast("bigint").alias("ga_visitors_avg"),
        last_non_null(cust, o).cast("bigint").alias("notion_customers_end"),
        (last_non_null(cust, o) - first_non_null(cust, o)).cast("bigint").alias("notion_customers_new"),
        last_non_null("notion_yearly_consumption_gwh", o).alias("notion_yearly_consumption_gwh"),
        F.sum("zoho_deals_new").cast("bigint").alias("zoho_deals_sum"),
        F.sum("zoho_deals_won").cast("bigint").alias("zoho_deals_won_sum"),
        F.sum("li_impressions").cast("bigint").alias("li_impressions_sum"),
        F.sum("li_views").cast("bigint").alias("li_views_sum"),
    )
