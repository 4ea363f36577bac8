"""Fact tables laid out by key (JON-5, SNK-1): bucketed, and partitioned by month and bucket.

``operators.facts.upsert_table`` keeps a month in one partition, so one changed
row rewrites the month of every tenant, and both sides of its join are shuffled.
Here a row's bucket (Spark's own bucket number of the key columns) is a
partition column under the month as well:

* the stored side of an upsert is a bucketed scan of the touched months and
  buckets and needs no exchange; only the updates are shuffled, to the buckets;
* only touched (month, bucket) partitions are rewritten; other files stay.

The table is registered in the session's catalog over a path, so another session
registers the same path again. Use at least as many buckets as
``spark.sql.shuffle.partitions``, else Spark prefers to shuffle the stored side;
a bucket of a month should be worth a file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_key
from ..session import ensure_runtime_conf, remove_path
from .facts import required_keys, staged, upsert

#: A join on all keys of the table accepts its bucketing by some of them.
SUBSET_JOIN = "spark.sql.requireAllClusterKeysForCoPartition"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket that Spark gives a row: the same number in a bucketed table and in ``repartition``."""
    return F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")


def fact_table(spark: SparkSession, name: str, path: str, schema: T.StructType, bucket_by: Sequence[str], buckets: int) -> str:
    """Register (and make, where there is none) a table over ``path``; returns its name."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{c}`" for c in bucket_by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, month STRING, bucket INT) USING parquet "
              f"PARTITIONED BY (month, bucket) CLUSTERED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return name


def _layout(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """(bucket columns, number of buckets) of a table."""
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return [c.strip(" `") for c in rows["Bucket Columns"].strip("[]").split(",")], int(rows["Num Buckets"])


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a job."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(df: DataFrame, name: str) -> None:
    """Replace the (month, bucket) partitions that ``df`` has rows of."""
    spark = df.sparkSession
    with _conf(spark, OVERWRITE, "dynamic"):                       # a table insert takes no such option
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


def touched_rows(spark: SparkSession, name: str, places: DataFrame) -> DataFrame:
    """Rows of the table in the (month, bucket) places. Literal lists prune the scan; the places themselves (at most
    months times buckets, a few bytes each) are broadcast and drop what the lists have in excess."""
    months = [r["month"] for r in places.select("month").distinct().collect()]
    numbers = [r["bucket"] for r in places.select("bucket").distinct().collect()]
    t = spark.table(name).where(F.col("month").isin(*months) & F.col("bucket").isin(*numbers))
    return t.join(F.broadcast(places), ["month", "bucket"], "left_semi").drop("month", "bucket")


def upsert_bucketed(spark: SparkSession, name: str, updates: DataFrame, keys: Sequence[str], order: str = "seq",
                    date_col: str = "date", keep_existing_on_null: bool = True) -> DataFrame:
    """SNK-1 on a table of ``fact_table``; returns the touched (month, bucket) places.

    The same merge as ``upsert_table``: one row per updated key, NULL fields
    keep what is stored, replays change nothing. The bucket columns must be
    among ``keys``.
    """
    ensure_runtime_conf(spark)
    bucket_by, buckets = _layout(spark, name)
    if not set(bucket_by) <= set(keys):
        raise ValueError(f"bucket columns {bucket_by} must be among the keys {list(keys)}")
    upd = required_keys(updates, [date_col]).withColumns(
        {"month": month_key(F.col(date_col)), "bucket": bucket_of(bucket_by, buckets)})
    # at most months times buckets rows
    places = spark.createDataFrame(upd.select("month", "bucket").distinct().collect(), "month string, bucket int")
    if places.isEmpty():
        return places
    with _conf(spark, SUBSET_JOIN, "false"):
        merged = merged_rows(spark, name, upd, places, keys, order, keep_existing_on_null)
        merged = merged.withColumns({"month": month_key(F.col(date_col)), "bucket": bucket_of(bucket_by, buckets)})
        new, stage = staged(merged, "bucketed")                   # it reads the partitions that it replaces
    _write(new, name)
    remove_path(spark, stage)
    return places


def merged_rows(spark: SparkSession, name: str, upd: DataFrame, places: DataFrame, keys: Sequence[str], order: str = "seq",
                keep_existing_on_null: bool = True) -> DataFrame:
    """The touched places' rows after the merge; the updates are reduced to one row per key and sent to the buckets."""
    return upsert(touched_rows(spark, name, places), upd.drop("month", "bucket"), keys, order, keep_existing_on_null)
