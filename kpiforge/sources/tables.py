"""Table scans (SRC-1..5): landed text tables -> typed DataFrames.

Sheets land every cell as text (SNK-6); on read, keys are typed and every
other column goes through the locale-aware ``parse_number`` expression
(UDF-1), all JVM side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import coerce_number, parse_number
from ..schemas import DAILY_SCHEMA, LEADS_SCHEMA, MONTHLY_SCHEMA, TARGETS_SCHEMA


def typed_from_text(raw: DataFrame, schema: T.StructType, on_bad: str = "zero") -> DataFrame:
    """Text columns -> ``schema``: dates (bad -> NULL), numbers with
    ``parse_number`` (bad, or beyond the column's range -> 0 or NULL), strings
    as text where an empty cell is the empty string (text tables have no NULL,
    as in a sheet). A bad cell never ends the scan. Columns outside the schema
    (grouping keys such as a tenant) pass through first."""
    known = set(schema.fieldNames())
    out = [F.col(c) for c in raw.columns if c not in known]
    for f in schema.fields:
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            out.append(F.trim(c).try_cast("date").alias(f.name))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            whole = parse_number(c, on_bad).try_cast(f.dataType)
            out.append((F.coalesce(whole, F.lit(0).cast(f.dataType)) if on_bad == "zero" else whole).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(parse_number(c, on_bad).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            out.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*out)


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_text_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a text table; CSV columns are matched by header name, not by
    position (all cells are text, so no type inference runs)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.schema(_text_schema(schema)).format(fmt).load(path)


def load_daily(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-1: daily facts; every column but ``date`` is a parsed number."""
    return typed_from_text(read_text_table(spark, path, DAILY_SCHEMA, fmt), DAILY_SCHEMA)


def load_monthly(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-2: monthly facts keyed by ``month`` text."""
    return typed_from_text(read_text_table(spark, path, MONTHLY_SCHEMA, fmt), MONTHLY_SCHEMA)


def load_targets(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-3: targets; ``target_yearly`` coerced with bad -> NULL (SCL-2).

    ``row_pos`` (which row of a KPI is the first) is read from a column of that
    name; a table without it, one small file, is numbered in file order.
    """
    raw = read_text_table(spark, path, TARGETS_SCHEMA, fmt)
    pos = F.col("row_pos").try_cast("bigint") if "row_pos" in raw.columns else F.monotonically_increasing_id() + 1
    return raw.select(pos.alias("row_pos"), "kpi", coerce_number("target_yearly").alias("target_yearly"), "unit", "category")


def load_leads(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-4: lead snapshot; a missing table is an empty frame."""
    from ..operators.facts import _exists
    if not _exists(spark, path):
        return spark.createDataFrame([], LEADS_SCHEMA)
    return typed_from_text(read_text_table(spark, path, LEADS_SCHEMA, fmt), LEADS_SCHEMA, on_bad="null")

