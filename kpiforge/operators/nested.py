"""Aggregates over nested documents (AGG-10, AGG-11, AGG-12).

Array work is done inside each row with higher-order functions
(``aggregate``, ``transform``, ``filter``) where possible, so documents are
reduced before any shuffle; decimal accumulators keep sums independent of
element order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import first_present, prop_ids, prop_number
from ..functions.numbers import exact_sum, round_half_up

_DEC = "decimal(38,9)"


def _with_keys(df: DataFrame, by: Sequence[Column | str]) -> tuple[DataFrame, list[str]]:
    """Materialise grouping expressions as named columns; returns their names."""
    names = df.select(*by).columns if by else []
    exprs = [b for b in by if not isinstance(b, str)]
    return (df.select("*", *exprs) if exprs else df), names


def positive_property_totals(pages: DataFrame, value_candidates: Sequence[str], formula_name: str | None,
                             by: Sequence[Column | str] = (), value_types=("number", "formula", "rollup"),
                             unit_divisor: float = 1e6, digits: int = 2) -> DataFrame:
    """AGG-10 (+ SCL-15/16/17/19): per group, pages, pages with a positive
    value, the positive values summed and converted (kWh -> GWh, rounded),
    and the positive formula values summed (rounded)."""
    props = F.col("properties")
    v = prop_number(first_present(props, list(value_candidates)), value_types)
    aggs = [F.count(F.lit(1)).alias("n_pages"),
            F.count_if(v > 0).alias("value_pages"),
            round_half_up(F.coalesce(exact_sum(F.when(v > 0, v)), F.lit(0.0)) / F.lit(unit_divisor), digits)
            .alias("total_converted")]
    if formula_name:
        p = prop_number(props.getItem(formula_name), ("formula",))
        aggs.append(F.coalesce(exact_sum(F.when(p > 0, p), digits), F.lit(0.0)).alias("formula_total"))
    return pages.groupBy(*by).agg(*aggs)


def element_totals(docs: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """AGG-11: impressions and views (clicks + engagement + page views, each
    missing -> 0) over ``elements[]`` of every document, per group."""
    el = F.col("elements")
    zero_l = F.lit(0).cast("bigint")

    def total(f):
        return F.aggregate(el, zero_l, lambda acc, e: acc + F.coalesce(f(e).cast("bigint"), zero_l))

    imp = total(lambda e: e["totalShareStatistics"]["impressionCount"])
    clicks = total(lambda e: e["totalShareStatistics"]["clickCount"])
    pviews = total(lambda e: e["pageStatistics"]["views"]["allPageViews"]["pageViews"])
    # engagement in two parts: through DECIMAL, so sums do not depend on order, and what that cuts off (or NaN)
    zero = F.lit(0).cast(_DEC)

    def head(e):
        return e["totalShareStatistics"]["engagement"].try_cast(_DEC)

    def tail(e):
        x = e["totalShareStatistics"]["engagement"]
        return F.coalesce(x - head(e).cast("double"), x, F.lit(0.0))

    eng = F.aggregate(el, zero, lambda acc, e: (acc + F.coalesce(head(e), zero)).cast(_DEC))
    cut = F.aggregate(el, F.lit(0.0), lambda acc, e: acc + tail(e))
    docs, by = _with_keys(docs, by)
    per_doc = docs.select(*by, imp.alias("_imp"), clicks.alias("_clk"), pviews.alias("_pv"), eng.alias("_eng"), cut.alias("_cut"))
    return per_doc.groupBy(*by).agg(
        F.sum("_imp").cast("bigint").alias("impressions"),
        ((F.sum("_eng") + F.sum("_clk") + F.sum("_pv")).cast("double") + F.sum("_cut")).alias("views"),
    )


def distinct_identities(pages: DataFrame, candidates: Sequence[str], by: Sequence[Column | str] = (),
                        value_candidates: Sequence[str] = ("kWh",)) -> DataFrame:
    """AGG-12 / SET-4: distinct identities named by a heterogeneous property
    (title, rich text, select, relation list), pages and positive values.

    ``posexplode_outer`` keeps pages whose property is empty; page-level
    counts use the first position only, so each page counts once.
    """
    props = F.col("properties")
    ids = prop_ids(first_present(props, list(candidates)))
    v = prop_number(first_present(props, list(value_candidates)))
    pages, by = _with_keys(pages, by)
    e = pages.select(*by, v.alias("_v"), F.posexplode_outer(ids).alias("_pos", "_id"))
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    return e.groupBy(*by).agg(
        F.count_if(first).alias("n_pages"),
        F.count_distinct("_id").alias("n_customers"),
        F.count_if(first & (F.col("_v") > 0)).alias("value_positive"),
    )
