"""Text column expressions (SCL-10, SCL-11, SCL-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c) -> Column:
    """SCL-10: trimmed key text before comparison."""
    return F.trim(_c(c))


def full_name(first, last) -> Column:
    """SCL-11: 'first last' trimmed; missing parts become empty."""
    return F.trim(F.concat_ws(" ", F.coalesce(_c(first), F.lit("")), F.coalesce(_c(last), F.lit(""))))


def name_of(raw) -> Column:
    """SCL-18: a field that is either ``{"name": ...}`` JSON, plain text or NULL -> name text."""
    r = _c(raw)
    is_obj = F.ltrim(r).startswith("{")
    return (F.when(r.isNull(), F.lit(""))
            .when(is_obj, F.coalesce(F.get_json_object(r, "$.name"), F.lit("")))
            .otherwise(r))
