"""Window and positional operators over daily facts (WIN-1..4, WIN-7, WIN-8, FLT-1, RPT-8).

All windows here run on the daily fact table, which holds one row per day
and group (``by``, e.g. tenant); they are partitioned by ``by``, so each
window partition holds at most one row per calendar day of one group. Row
level detail (events, orders) never reaches these windows: it is reduced to
daily facts first.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import pct_change


def _order(df: DataFrame, date_col: str, desc: bool = False) -> list[Column]:
    cols = [date_col] + (["seq"] if "seq" in df.columns else [])
    return [F.col(c).desc() if desc else F.col(c).asc() for c in cols]


def period_sum_delta(daily: DataFrame, cols: Sequence[str], periods: Sequence[int] = (7, 14, 30, 90),
                     by: Sequence[str] = (), date_col: str = "date") -> DataFrame:
    """WIN-1/WIN-2/ORD-3/SCL-13: sum of the last N rows and of the N rows
    before them (only when at least 2N rows exist, else 0), with the change
    in percent when the previous sum is positive.

    One ranking window per group, then a single aggregation that computes
    every (period, column) pair with conditional sums; the long output is
    produced by exploding a small in-row array, not by a join.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(*_order(daily, date_col, desc=True))
    r = daily.select(*by, *cols, F.row_number().over(w).alias("_rn"))
    rn = F.col("_rn")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for n in periods:
        for c in cols:
            aggs.append(F.coalesce(F.sum(F.when(rn <= n, F.col(c))), F.lit(0)).alias(f"cur_{n}_{c}"))
            aggs.append(F.coalesce(F.sum(F.when((rn > n) & (rn <= 2 * n), F.col(c))), F.lit(0))
                        .alias(f"prev_{n}_{c}"))
    a = r.groupBy(*by).agg(*aggs)
    items = []
    for n in periods:
        for c in cols:
            prev = F.when(F.col("_rows") >= 2 * n, F.col(f"prev_{n}_{c}")).otherwise(F.lit(0))
            items.append(F.struct(F.lit(n).alias("days"), F.lit(c).alias("kpi"),
                                  F.col(f"cur_{n}_{c}").cast("bigint").alias("current"),
                                  prev.cast("bigint").alias("previous")))
    out = a.select(*by, F.explode(F.array(*items)).alias("_x")).select(*by, "_x.*")
    return out.withColumn("delta_pct", pct_change("current", "previous"))


def trailing_sum_series(daily: DataFrame, col: str, n: int = 7, by: Sequence[str] = (),
                        date_col: str = "date") -> DataFrame:
    """WIN-1/WIN-2 series form: per row, the sum of the last ``n`` rows and of
    the ``n`` rows before those (NULL until ``2n`` rows exist)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(*_order(daily, date_col))
    cur = F.sum(col).over(w.rowsBetween(-(n - 1), 0))
    prev = F.sum(col).over(w.rowsBetween(-(2 * n - 1), -n))
    seen = F.count(F.lit(1)).over(w.rowsBetween(-(2 * n - 1), 0))
    out = daily.select(*by, date_col, F.col(col).alias("value"),
                       cur.cast("bigint").alias("current"),
                       F.when(seen == 2 * n, prev).cast("bigint").alias("previous"))
    return out.withColumn("delta_pct", pct_change("current", "previous"))


def offset_delta(daily: DataFrame, col: str, n: int = 7, by: Sequence[str] = (),
                 date_col: str = "date") -> DataFrame:
    """WIN-3: change against the row ``n`` positions earlier; (0, 0) when
    fewer than n+1 rows exist or the earlier value is 0."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(*_order(daily, date_col))
    prev = F.lag(F.col(col), n).over(w)
    cur = F.col(col).cast("double")
    p = prev.cast("double")
    ok = prev.isNotNull() & (p != 0)
    return daily.select(*by, date_col, F.col(col).alias("value"), prev.alias("previous"),
                        F.when(ok, cur - p).otherwise(F.lit(0.0)).alias("delta_abs"),
                        F.when(ok, (cur - p) / p * 100).otherwise(F.lit(0.0)).alias("delta_pct"))


def last_known_delta(daily: DataFrame, col: str, by: Sequence[str] = (), date_col: str = "date",
                     known: Column | None = None) -> DataFrame:
    """WIN-4: change against the previous known value (``col > 0`` rows only);
    NULL when there is none."""
    by = list(by)
    k = daily.where(F.col(col) > 0 if known is None else known)
    w = Window.partitionBy(*by).orderBy(*_order(daily, date_col))
    prev = F.lag(F.col(col), 1).over(w)
    return k.select(*by, date_col, F.col(col).alias("value"), prev.alias("previous"),
                    (F.col(col) - prev).alias("delta"))


def max_date(daily: DataFrame, date_col: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """AGG-13: last update per group."""
    return daily.groupBy(*by).agg(F.max(date_col).alias("last_update"),
                                  F.count(F.lit(1)).alias("n_days"))


def trailing_range(daily: DataFrame, days: int, by: Sequence[str] = (), date_col: str = "date",
                   cols: Sequence[str] | None = None) -> DataFrame:
    """FLT-1 + RPT-8: rows with ``date >= max(date) - days`` (days+1 dates),
    plus the header facts ``last_update`` and ``n_days``.

    Without groups the maximum is a scalar subquery (computed once, inlined
    as a literal, so the predicate reaches the scan); with groups it is a
    per-group aggregate joined back on the group keys.
    """
    by = list(by)
    keep = list(cols) if cols is not None else [c for c in daily.columns if c not in by]
    if not by:
        stats = daily.agg(F.struct(F.max(date_col).alias("m"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
        last, n_days = stats.getField("m"), stats.getField("n")
        return (daily.where(F.col(date_col) >= F.date_sub(last, days))
                .select(*keep, last.alias("last_update"), n_days.alias("n_days")))
    m = max_date(daily, date_col, by)
    j = daily.join(m, by, "inner")
    return j.where(F.col(date_col) >= F.date_sub("last_update", days)).select(*by, *keep, "last_update", "n_days")


#: Types whose values an aggregation buffer can replace in place, as a hash aggregation needs.
FIXED_WIDTH = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _null_first(df: DataFrame, order: str | Column) -> Column:
    """An order that is never NULL: rows with a NULL ``order`` come first. (``min_by`` and ``max_by``
    skip rows whose order is NULL, which would lose a key that has no other row.)"""
    o = F.col(order) if isinstance(order, str) else order
    if isinstance(order, str) and isinstance(df.schema[order].dataType, T.IntegralType):
        return F.coalesce(o.cast("decimal(20,0)") + F.lit(Decimal(1 + (1 << 63))), F.lit(0))    # from 1 on
    return F.struct(o.isNotNull(), o)


def _one_per_key(df: DataFrame, keys: Sequence[str], order: str | Column, pick) -> DataFrame:
    """The row per key that ``pick`` (``min_by`` or ``max_by``) chooses.

    With columns of fixed width and a whole-number order every column is picked
    on its own, all by the same comparisons, in one hash aggregation; otherwise
    the row is picked as a struct.
    """
    keys = list(keys)
    rest, key = [c for c in df.columns if c not in keys], _null_first(df, order)
    types = [df.schema[c].dataType for c in rest]
    whole = isinstance(order, str) and isinstance(df.schema[order].dataType, T.IntegralType)
    if rest and whole and all(isinstance(t, FIXED_WIDTH) for t in types):
        return df.groupBy(*keys).agg(*[pick(F.col(c), key).alias(c) for c in rest])
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), key).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """WIN-7 / SET-3: the first row per key by ``order`` (NULL first).

    An aggregation, so a key with a third of all rows is reduced map-side
    instead of landing in one window partition.
    """
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Counterpart of ``first_per_key``: the last row per key (NULL first, so a NULL order loses to any other)."""
    return _one_per_key(df, keys, order, F.max_by)


def pct_of_first(value: str, order: str, by: Sequence[str] = ()) -> Column:
    """WIN-8: value as percent of the first value in order (funnel 'percent initial')."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.col(value)).over(w).cast("double")
    return F.when(first > 0, F.col(value).cast("double") / first * 100)
