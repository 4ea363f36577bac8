"""Fact-table maintenance (JON-1, JON-4, JON-5, PRJ-4, SET-1..3, SNK-1..6).

The pure operators return DataFrames (merge, upsert, backfill, dedupe);
the ``*_table`` functions persist them:

* keyed upsert into a month-partitioned Parquet table: only partitions
  between the batch's first and last month are read, and only touched months
  rewritten, with ``partitionOverwriteMode=dynamic`` set per write;
* lineage is cut with a table written below the shared
  ``spark.checkpoint.dir`` before a path that is being read is overwritten,
  so a lost executor can never recompute from files that are being replaced;
  it is removed after the write.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_key
from ..session import ensure_runtime_conf, remove_path, scratch_path
from .windows import first_per_key, last_per_key


def _default_for(dtype: T.DataType):
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        return 0
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return 0.0
    return None


def fill_defaults(df: DataFrame, cols: Sequence[str] | None = None, defaults: Mapping | None = None) -> DataFrame:
    """PRJ-4: NULL -> default (0 for integers, 0.0 for doubles) per column."""
    defaults = dict(defaults or {})
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else list(df.columns)
    out = []
    for c in df.columns:
        d = defaults.get(c, _default_for(types[c])) if c in cols else None
        out.append(F.coalesce(F.col(c), F.lit(d).cast(types[c])).alias(c) if d is not None else F.col(c))
    return df.select(*out)


def merge_sources(frames: Sequence[DataFrame], key: str | Sequence[str] = "date", defaults: Mapping | None = None,
                  fill: bool = True) -> DataFrame:
    """JON-1: merge per-source records on ``key`` (one column or several); a later source wins on a
    shared column; a source absent for a key leaves NULL (or the default).

    One union and one aggregation: per key and column the last non-NULL value
    in source order, so a key that repeats inside a source still gives one row
    (of equal sources the larger value, so the result does not depend on row order).
    """
    if not frames:
        raise ValueError("no sources")
    keys = [key] if isinstance(key, str) else list(key)
    union, holds = None, {}
    for rank, f in enumerate(frames):
        for c in f.columns:
            holds.setdefault(c, []).append(rank)
        f = f.withColumn("_rank", F.lit(rank))
        union = f if union is None else union.unionByName(f, allowMissingColumns=True)
    cols = [c for c in union.columns if c not in (*keys, "_rank")]
    # a maximum per source that has the column, not one over (source, value) pairs: the former is a hash aggregation
    last = [F.coalesce(*[F.max(F.when(F.col("_rank") == r, F.col(c))) for r in reversed(holds[c])]).alias(c) for c in cols]
    merged = union.groupBy(*keys).agg(*last) if last else union.select(*keys).distinct()
    return fill_defaults(merged, cols, defaults) if fill else merged


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """SET-3: keep the first row (by ``order``) of each key."""
    return first_per_key(df, keys, order)


def required_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job on a NULL key: it would match nothing and be added again by every replay."""
    return df.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"NULL in key column {k}"))).otherwise(F.col(k))
                           for k in keys})


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: str = "seq",
           keep_existing_on_null: bool = True, defaults: Mapping | None = None) -> DataFrame:
    """SNK-1 / SNK-4 / JON-5 / SET-3 / STR-2: keyed upsert.

    Keys in ``updates`` get exactly one row: the latest update (by
    ``order``); with ``keep_existing_on_null`` a NULL field keeps the value
    of the first existing row of that key, then falls back to the column
    default (PRJ-4). Keys not updated keep all their existing rows. Running
    it twice with the same updates gives the same table (idempotent).
    ``updates`` must have the order column; in it NULL sorts first. A NULL key
    in ``updates`` fails the job; existing rows with a NULL key stay.

    The updates are reduced to one row per key map-side; then one outer join
    reads either side once. The rank of a key's existing rows is a window on
    the join keys, so it uses the join's shuffle and sort.
    """
    ensure_runtime_conf(existing.sparkSession)
    keys, cols = list(keys), existing.columns
    if order not in updates.columns:
        raise ValueError(f"updates need the order column {order!r}")
    types = {f.name: f.dataType for f in existing.schema.fields}
    missing = [c for c in cols if c not in updates.columns]
    updates = updates.select(*[F.lit(None).cast(types[c]).alias(c) if c in missing else F.col(c) for c in cols])
    rest = [c for c in cols if c not in keys]
    latest = last_per_key(required_keys(updates, keys), keys, order).select(*keys, F.struct(*rest).alias("_new"))
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
    j = existing.withColumn("_rank", F.row_number().over(w)).join(latest, keys, "full_outer")
    updated = F.col("_new").isNotNull()
    j = j.where(~updated | F.coalesce(F.col("_rank") == 1, F.lit(True)))

    def merged(c: str) -> Column:
        new = F.col("_new").getField(c)
        if c == order:
            return new
        d = dict(defaults or {}).get(c, _default_for(types[c]))
        options = [new, *([F.col(c)] if keep_existing_on_null else []), *([F.lit(d).cast(types[c])] if d is not None else [])]
        return F.coalesce(*options)

    return j.select(*[F.col(c) if c in keys else F.when(updated, merged(c)).otherwise(F.col(c)).alias(c) for c in cols])


def backfill(existing: DataFrame, history: DataFrame, key: str | Sequence[str] = "date",
             defaults: Mapping | None = None, order: str = "seq") -> DataFrame:
    """SNK-2 / JON-4 / SET-2: append only keys that are not present yet;
    columns the history lacks get their defaults (name-based, SURVEY Q9). A key
    that repeats in the history is appended once: its last row by ``order``,
    or any one without that column."""
    ensure_runtime_conf(existing.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    new = one_per_key(history, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    types = {f.name: f.dataType for f in existing.schema.fields}
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(types[c]).alias(c) for c in existing.columns])
    new = fill_defaults(new, [c for c in existing.columns if c not in keys and c not in history.columns], defaults)
    return existing.unionByName(new)


def one_per_key(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """One row per key, which must not be NULL: the last by ``order`` where that column exists."""
    df = required_keys(df, keys)
    return last_per_key(df, keys, order).select(*df.columns) if order in df.columns else df.dropDuplicates(list(keys))


# --- persistence -------------------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared ``spark.checkpoint.dir`` and read back, and its path (to be removed after use)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_partitioned(df: DataFrame, path: str, partition_col: str = "month", mode: str = "overwrite") -> None:
    """Write with dynamic partition overwrite: only partitions present in
    ``df`` are replaced; other partitions stay untouched.

    Rows are rebalanced by the partition column (``REBALANCE`` hint): adaptive
    execution keeps each partition in few files but splits a partition that
    holds a large share of the rows over several tasks, so neither a hot
    month nor many small files hurt.
    """
    (df.hint("rebalance", partition_col).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def month_bounds(df: DataFrame) -> tuple[str, str] | None:
    """Smallest and largest ``month`` (one scalar row); None for an empty frame."""
    r = df.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).first()
    return (r["lo"], r["hi"]) if r["lo"] is not None else None


def read_months(spark: SparkSession, path: str, lo: str, hi: str | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """The table's rows from month ``lo`` to ``hi`` (or the end): literal bounds, so other partitions are not read."""
    reader = spark.read.schema(schema_with_month(schema)) if schema is not None else spark.read
    df = reader.parquet(path).where(F.col("month") >= F.lit(lo))
    return df if hi is None else df.where(F.col("month") <= F.lit(hi))


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str] = ("date",),
                 order: str = "seq", date_col: str = "date", schema: T.StructType | None = None,
                 keep_existing_on_null: bool = True) -> DataFrame:
    """SNK-1 on a month-partitioned table; returns the touched months.

    Reads only partitions between the batch's first and last month (literal
    bounds), of these the rows of touched months, merges, stages and
    rewrites the touched months. The first write is the same merge, with an
    empty table, so a replay of the batch changes nothing.
    """
    upd = required_keys(updates, [date_col]).withColumn("month", month_key(F.col(date_col)))
    touched = upd.select("month").distinct()
    bounds = month_bounds(touched)
    if bounds is None:
        return touched
    if _exists(spark, path):
        current = read_months(spark, path, *bounds, schema=schema)
        existing = current.join(touched, "month", "left_semi").drop("month")
    else:
        existing = spark.createDataFrame([], schema or updates.schema)
    merged = upsert(existing, upd.drop("month"), keys, order, keep_existing_on_null)
    merged = merged.withColumn("month", month_key(F.col(date_col)))
    if _exists(spark, path):
        # the merge reads the partitions it is about to replace: cut lineage first
        merged, stage = staged(merged, "upsert")
        write_partitioned(merged, path, "month")
        remove_path(spark, stage)
    else:
        write_partitioned(merged, path, "month")
    return touched


def schema_with_month(schema: T.StructType) -> T.StructType:
    if "month" in schema.fieldNames():
        return schema
    return T.StructType(schema.fields + [T.StructField("month", T.StringType())])


def write_snapshot(df: DataFrame, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> None:
    """SNK-3 (+ SNK-5 / SNK-6): replace the whole snapshot table. With
    ``fmt='csv'`` every cell is written as text (locale-safe)."""
    from ..schemas import enforce_schema
    out = enforce_schema(df, schema) if schema is not None else df
    if fmt == "csv":
        out.select(*[F.col(c).cast("string").alias(c) for c in out.columns]).write.mode("overwrite") \
            .option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """SRC-1/2/4: read a table with a declared schema; a missing table reads
    as an empty frame of that schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        from ..sources.tables import read_text_table, typed_from_text
        return typed_from_text(read_text_table(spark, path, schema, "csv"), schema)
    return spark.read.schema(schema).parquet(path)
