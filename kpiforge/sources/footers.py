"""Counts and bounds of stored Parquet tables from file footers (AGG-9, AGG-13, AGG-16, SRC-5).

A health report, a gap check or "the last day we have" asks for row counts,
counts of values, and the least and greatest day of a table, in all or per
partition (month). Every Parquet file states these in its footer, so Spark's
second file source answers them without reading a row: the work grows with the
number of files, not of rows.

Footers bound numbers without a fraction, truth values and dates; texts,
timestamps, decimals and doubles (whose bounds footers cut off, or which may
hold NaN) are refused. A file whose column holds only NULL states no bound, and
Spark then ends the job, so a column's bounds come from footers only if the
footers' counts show it free of NULL, as keys are, and from a scan of this one
column otherwise. The results are the same either way. An empty table has 0
rows and NULL bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facts import _exists
from ..session import ensure_runtime_conf

#: Types whose bounds a footer states exactly.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)
_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def read_footers(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as Spark's second file source reads it. Counts, minima and
    maxima over all rows, or grouped by all partition columns in their order,
    come from footers; anything else is an ordinary scan."""
    ensure_runtime_conf(spark)
    first = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(s for s in first.split(",") if s.strip().lower() != "parquet"))
    try:                                       # the source is chosen when the path is resolved, which is here
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    finally:
        spark.conf.set(_V1_SOURCES, first)


def table_stats(spark: SparkSession, path: str, bounds: Sequence[str] = (), counted: Sequence[str] = (),
                by: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """``n_rows``, ``<c>_min`` and ``<c>_max`` of the columns ``bounds``, ``<c>_n``
    (values that are not NULL) of ``counted``.

    One row, or one per value of ``by``, which must be all partition columns of
    the table in their order. One row of counts is fetched to decide where
    bounds come from (see the module).
    """
    t = read_footers(spark, path, schema)
    for c in bounds:
        if not isinstance(t.schema[c].dataType, BOUNDED):
            raise ValueError(f"no exact bounds of {t.schema[c].dataType.simpleString()} column {c!r} in footers")
    by = list(by)
    rows = F.count(F.lit(1)).alias("n_rows")

    def ends(names):
        return [f(c).alias(f"{c}_{n}") for c in names for n, f in (("min", F.min), ("max", F.max))]

    seen = t.agg(rows, *[F.count(c).alias(f"_{i}") for i, c in enumerate(bounds)]).first()
    plain = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if not seen["n_rows"]:                     # pushed counts of files without rows are NULL, and there is nothing to scan
        t, scanned = plain, []
    else:
        scanned = [c for i, c in enumerate(bounds) if seen[f"_{i}"] < seen["n_rows"]]
    aggs = [rows, *ends([c for c in bounds if c not in scanned]), *[F.count(c).alias(f"{c}_n") for c in counted]]
    out = t.groupBy(*by).agg(*aggs)
    if scanned:
        found = plain.groupBy(*by).agg(*ends(scanned))
        if by:
            found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in found.columns if c not in by])
            same = [out[c].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate(by)]
            out = out.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(by))])
        else:
            out = out.crossJoin(found)                     # one row each
    ordered = [f"{c}_{n}" for c in bounds for n in ("min", "max")]
    return out.select(*by, "n_rows", *ordered, *[f"{c}_n" for c in counted])


def stored_health(spark: SparkSession, tables: Mapping[str, tuple[str, str | None]], expected: Sequence[str]) -> DataFrame:
    """AGG-16 on stored tables: name and place of each expected table, whether it
    is there, its rows, and the first and last date of its key column.

    ``tables``: name -> (path, date column or None). No data file's rows are read.
    """
    unknown = sorted(set(expected) - set(tables))
    parts = []
    for pos, name in enumerate(expected, 1):
        path, day = tables.get(name, (None, None))
        if name in unknown or not _exists(spark, path):
            s = spark.range(1).select(F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("n_rows"),
                                      *[F.lit(None).cast("date").alias(c) for c in ("first_date", "last_date")])
        else:
            s = table_stats(spark, path, [day] if day else []).select(
                F.lit(True).alias("present"), "n_rows",
                (F.col(f"{day}_min") if day else F.lit(None).cast("date")).alias("first_date"),
                (F.col(f"{day}_max") if day else F.lit(None).cast("date")).alias("last_date"))
        parts.append(s.select(F.lit(name).alias("table_name"), F.lit(pos).alias("pos"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def months_with_gaps(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """SRC-5: the months of a daily fact table (one row per day, partitioned by
    ``month`` as yyyy-MM) that lack days, with the days they have and lack.

    Months without any day between the table's first and last one (or the given
    ``first`` and ``last``) lack all. A gap-only backfill has to look at the
    days of these months only.
    """
    per_month = table_stats(spark, path, by=["month"])
    there = per_month.select(F.col("month").cast("string").alias("month"), "n_rows")

    def end(given, f):
        return F.lit(given) if given is not None else there.agg(f("month").alias("m")).select("m").scalar()

    span = F.sequence(F.to_date(end(first, F.min), "yyyy-MM"), F.to_date(end(last, F.max), "yyyy-MM"), F.expr("INTERVAL 1 MONTH"))
    calendar = spark.range(1).select(F.explode(span).alias("_d")).select(
        F.date_format("_d", "yyyy-MM").alias("month"), F.dayofmonth(F.last_day("_d")).cast("bigint").alias("_days"))
    have = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    return (calendar.join(there, "month", "left").select("month", have.alias("days"), (F.col("_days") - have).alias("missing"))
            .where(F.col("missing") > 0))
