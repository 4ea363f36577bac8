"""Numeric column expressions (SCL-1, SCL-2, SCL-12..15). No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number after separators are normalised. Python's float()
# also takes "inf", "nan" and "1_000"; those are treated as bad values here.
_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DEC = "decimal(38,9)"
_EDGE_SPACE = r"^[\s ]+|[\s ]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last_pos(s: Column, ch: str) -> Column:
    """1-based position of the last ``ch`` in ``s``; 0 if absent."""
    r = F.instr(F.reverse(s), ch)
    return F.when(r > 0, F.length(s) - r + 1).otherwise(F.lit(0))


def normalize_number_text(c) -> Column:
    """Locale normalisation step of SCL-1: DE/EN separators -> plain text.

    Both separators present: the later one is the decimal mark and the other
    is a thousands mark. Only commas: comma is the decimal mark. Only dots or
    none: unchanged.
    """
    s = F.regexp_replace(_c(c).cast("string"), _EDGE_SPACE, "")
    dot, comma = _last_pos(s, "."), _last_pos(s, ",")
    de = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    en = F.regexp_replace(s, ",", "")
    return (F.when((dot > 0) & (comma > 0) & (comma > dot), de)
            .when((dot > 0) & (comma > 0), en)
            .when(comma > 0, F.regexp_replace(s, ",", "."))
            .otherwise(s))


def parse_number(c, on_bad: str = "zero") -> Column:
    """SCL-1 / UDF-1: locale-aware number parse.

    "5.13" -> 5.13, "5,13" -> 5.13, "1.234,56" -> 1234.56,
    "1,234.56" -> 1234.56, "1.234" -> 1.234, "1,234,567" -> bad.
    Empty, "None", NULL and unparsable text give 0.0 with ``on_bad='zero'``
    (parity) or NULL with ``on_bad='null'``.
    """
    if on_bad not in ("zero", "null"):
        raise ValueError("on_bad must be 'zero' or 'null'")
    s = normalize_number_text(c)
    good = s.rlike(_PLAIN_NUMBER)
    val = F.when(good, s.try_cast("double"))
    return F.coalesce(val, F.lit(0.0)) if on_bad == "zero" else val


def coerce_number(c) -> Column:
    """SCL-2: plain numeric coercion, bad -> NULL (no comma support)."""
    s = F.regexp_replace(_c(c).cast("string"), _EDGE_SPACE, "")
    return F.when(s.rlike(_PLAIN_NUMBER), s.try_cast("double"))


def round_half_up(c, digits: int = 2) -> Column:
    """SCL-12: decimal half-up rounding of a double, reproducible across engines
    (to at most 9 digits). NaN, infinities and values beyond DECIMAL(38,9) stay as they are."""
    if digits > 9:
        raise ValueError("at most 9 digits")
    return F.coalesce(F.round(_c(c).try_cast(_DEC), digits).cast("double"), _c(c).cast("double"))


def round_half_even(c, digits: int = 0) -> Column:
    """SCL-12: banker's rounding (``bround``)."""
    return F.bround(_c(c), digits)


def exact_sum(c, digits: int | None = None) -> Column:
    """Sum of a double column through DECIMAL, so totals do not depend on order.

    Two decimals cover 9 digits each: what the first cuts off (below 1e-9) is
    scaled and summed by the second. A NaN makes the sum NaN, as an infinity
    makes it infinite; with one of these, or a value beyond 1e28, the plain
    double sum is given.
    """
    x = _c(c).cast("double")
    head = x.try_cast(_DEC)
    tail = ((x - head.cast("double")) * F.lit(1e18)).try_cast(_DEC)
    outside = F.max(x.isNotNull() & head.isNull())
    rest = F.sum(tail).cast("double") / F.lit(1e18)
    if digits is not None:
        exact = F.round((F.sum(head) + rest.cast(_DEC)).cast(_DEC), digits).cast("double")
    else:
        exact = F.sum(head).cast("double") + rest
    return F.when(outside, F.sum(x)).otherwise(exact)


def pct_change(cur, prev) -> Column:
    """SCL-13: (cur - prev) / prev * 100 when prev > 0, else NULL."""
    cur, prev = _c(cur).cast("double"), _c(prev).cast("double")
    return F.when(prev > 0, (cur - prev) / prev * 100)


def bounce_with_fallback(bounce_pct, engagement_pct) -> Column:
    """SRC-12: bounce rate, or ``100 - engagement rate`` when the bounce rate
    is missing (both in percent)."""
    return F.coalesce(_c(bounce_pct).cast("double"), F.lit(100.0) - _c(engagement_pct).cast("double"))


def clamp(c, low=None, high=None) -> Column:
    """SCL-14: greatest(low, least(high, c))."""
    out = _c(c)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return out


def kwh_to_gwh(c) -> Column:
    """SCL-15."""
    return _c(c) / F.lit(1e6)
