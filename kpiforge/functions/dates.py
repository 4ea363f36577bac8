"""Date column expressions (SCL-3..9)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date_lit(d) -> Column:
    """A date literal from ``datetime.date`` / ISO text / Column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.to_date(F.lit(str(d)))


def yyyymmdd_to_date(c) -> Column:
    """SCL-3: 'YYYYMMDD' text -> DATE (NULL when malformed)."""
    return F.try_to_timestamp(_c(c), F.lit("yyyyMMdd")).cast("date")


def month_key(c) -> Column:
    """SCL-4: 'yyyy-MM'."""
    return F.date_format(_c(c), "yyyy-MM")


def days_before(as_of, n: int) -> Column:
    """SCL-5: ``as_of - n`` days (yesterday = 1, 14-day cutoff = 14)."""
    return F.date_sub(as_of_date(as_of), n)


def as_of_date(as_of) -> Column:
    return as_date_lit(as_of)


def year_start(year) -> Column:
    return F.make_date(F.lit(year) if isinstance(year, int) else year, F.lit(1), F.lit(1))


def in_year(c, year: int) -> Column:
    """FLT-2: calendar-year filter written as a range, so it prunes partitions."""
    d = _c(c)
    return (d >= F.lit(_dt.date(year, 1, 1))) & (d < F.lit(_dt.date(year + 1, 1, 1)))


def days_in_year(c) -> Column:
    """SCL-6: 365 or 366."""
    return F.dayofyear(F.make_date(F.year(_c(c)), F.lit(12), F.lit(31)))


def year_progress(c) -> Column:
    """SCL-6: day of year / days in year, as DOUBLE."""
    d = _c(c)
    return F.dayofyear(d).cast("double") / days_in_year(d)


MS_PER_DAY = 86_400_000


def day_start_ms(c) -> Column:
    """SCL-7: epoch milliseconds of the (UTC) day start; independent of the
    session time zone."""
    return F.unix_date(_c(c).cast("date")).cast("bigint") * MS_PER_DAY


def day_end_ms(c) -> Column:
    """SCL-7: epoch milliseconds of the next (UTC) day start."""
    return (F.unix_date(_c(c).cast("date")).cast("bigint") + 1) * MS_PER_DAY


def date_of_ms(c) -> Column:
    """The UTC date of an epoch-milliseconds value (inverse of ``day_start_ms``)."""
    return F.date_from_unix_date(F.floor(_c(c) / MS_PER_DAY).cast("int"))


def utc_instant(c) -> Column:
    """A ``timestamp_ntz`` wall clock as the TIMESTAMP instant with that wall
    clock in UTC, independent of the session time zone (needed where Spark
    requires a TIMESTAMP, e.g. watermarks)."""
    t = _c(c)
    micros = (F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000
              + F.hour(t).cast("bigint") * 3_600_000_000 + F.minute(t).cast("bigint") * 60_000_000
              + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint"))
    return F.timestamp_micros(micros)


def weekend_factor(c, weekend: float = 0.6, weekday: float = 1.0) -> Column:
    """SCL-8: ``weekend`` on Saturday and Sunday, else ``weekday``."""
    return F.when(F.weekday(_c(c)) >= 5, F.lit(weekend)).otherwise(F.lit(weekday))


def iso_date_prefix(c) -> Column:
    """SCL-9: first 10 characters of an ISO timestamp text, typed as DATE."""
    return F.try_to_timestamp(F.substring(_c(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
