"""Lead counts over a stream of changing leads (AGG-8, FLT-8, STR-1).

Lead changes land as files. The last known state of every lead is a table,
split by a hash of the lead's key, of which a micro-batch reads and rewrites
only the parts that it touches. What a change does to the counts is stored as
differences: -1 for the class that the lead leaves and +1 for the one that it
enters, so a lead that moves from active to won changes both.

Whether an open lead is new or active depends on the day of the report, without
any change of the lead. Differences are therefore kept per class (open, won,
lost, waiting) and created date, and ``read_status_counts`` draws the line
between new and active for the day asked for.

Changes are ordered by ``order``, not by arrival: one that is older than what is
known changes nothing. A row whose stage is NULL takes the lead out. A state row
remembers its batch and what was before it, so a replayed batch computes the
same differences and replaces its own partition of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import as_of_date
from ..operators.facts import _exists, one_per_key, required_keys, staged
from ..schemas import LOST_STAGES, NEW_LEAD_DAYS, WAITING_STAGES, WON_STAGES
from ..session import remove_path

#: Parts of the state table. A batch that touches few leads rewrites few of them.
PARTS = 64

CHANGES_SCHEMA = T.StructType([
    T.StructField("lead_id", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("created_date", T.DateType()),
    T.StructField("seq", T.LongType()),
])


def stage_class(stage: Column) -> Column:
    """FLT-8 without the report's day: open, won, lost or waiting; NULL for a lead that is gone."""
    return (F.when(stage.isin(*WON_STAGES), "won").when(stage.isin(*LOST_STAGES), "lost")
            .when(stage.isin(*WAITING_STAGES), "waiting").when(stage.isNotNull(), "open"))


def apply_changes(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, epoch: int) -> DataFrame:
    """The state rows of the leads that ``changes`` touches or that lie beside them, as of after the batch.

    Columns: keys, ``class``, ``created_date``, order, ``epoch``, and ``was_class``
    and ``was_created``, what held before the row's batch.
    """
    c = F.col
    latest = one_per_key(changes, keys, order).select(
        *keys, stage_class(c("stage")).alias("_class"), c("created_date").alias("_created"), c(order).alias("_order"))
    j = state.join(latest, list(keys), "full_outer")
    replayed = c("epoch") == epoch                       # the row is this batch's own: go back to what was before
    base_class, base_created = F.when(replayed, c("was_class")).otherwise(c("class")), F.when(replayed, c("was_created")).otherwise(c("created_date"))
    newer = c("_order").isNotNull() & (c(order).isNull() | (c("_order") > c(order)) | (replayed & (c("_order") == c(order))))
    picked = lambda new, old: F.when(newer, c(new)).otherwise(c(old))
    return j.select(*keys, picked("_class", "class").alias("class"), picked("_created", "created_date").alias("created_date"),
                    picked("_order", order).alias(order), F.when(newer, F.lit(epoch)).otherwise(c("epoch")).cast("long").alias("epoch"),
                    F.when(newer, base_class).otherwise(c("was_class")).alias("was_class"),
                    F.when(newer, base_created).otherwise(c("was_created")).alias("was_created"))


def differences(state: DataFrame, epoch: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, created_date, n): what the batch ``epoch`` did to the counts; leads that stayed put cancel out."""
    s = state.where(F.col("epoch") == epoch)
    moves = F.array(F.struct(F.col("class").alias("class"), F.col("created_date").alias("created_date"), F.lit(1).alias("n")),
                    F.struct(F.col("was_class").alias("class"), F.col("was_created").alias("created_date"), F.lit(-1).alias("n")))
    d = s.select(*by, F.explode(moves).alias("m")).select(*by, "m.*").where(F.col("class").isNotNull())
    return d.groupBy(*by, "class", "created_date").agg(F.sum("n").alias("n")).where("n <> 0")


def change_batch(changes: DataFrame, epoch: int, state_path: str, counts_path: str, keys: Sequence[str] = ("lead_id",),
                 order: str = "seq", by: Sequence[str] = (), parts: int = PARTS) -> None:
    """One micro-batch: touched parts of the state, then the differences of this batch."""
    spark, keys = changes.sparkSession, list(keys)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    changes, at = staged(required_keys(changes, keys).withColumn("part", part), "changes")
    touched = sorted(r["part"] for r in changes.select("part").distinct().collect())      # at most ``parts``
    if touched:
        known = [changes.schema[k] for k in keys]
        kind = T.StructType(known + [T.StructField("class", T.StringType()), T.StructField("created_date", T.DateType()), changes.schema[order],
                                     T.StructField("epoch", T.LongType()), T.StructField("was_class", T.StringType()),
                                     T.StructField("was_created", T.DateType()), T.StructField("part", T.IntegerType())])
        state = spark.read.schema(kind).parquet(state_path) if _exists(spark, state_path) else spark.createDataFrame([], kind)
        state = state.where(F.col("part").isin(*touched))                                 # other parts are not read
        new, stage = staged(apply_changes(state.drop("part"), changes, keys, order, epoch).withColumn("part", part), "state")
        _replace(differences(new, epoch, by).withColumn("epoch", F.lit(epoch).cast("long")), counts_path, "epoch")
        _replace(new.repartition("part"), state_path, "part")
        remove_path(spark, stage)
    remove_path(spark, at)


def _replace(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def start_lead_status(spark: SparkSession, landing_path: str, state_path: str, counts_path: str, checkpoint_path: str,
                      schema: T.StructType = CHANGES_SCHEMA, keys: Sequence[str] = ("lead_id",), order: str = "seq",
                      by: Sequence[str] = (), trigger: str = "availableNow", max_files: int | None = None,
                      parts: int = PARTS) -> StreamingQuery:
    """Start the stream of lead changes. ``by``: grouping columns, which must be among ``keys``."""
    if not set(by) <= set(keys):
        raise ValueError("grouping columns must be among the keys")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (reader.parquet(landing_path).writeStream
              .foreachBatch(lambda df, e: change_batch(df, e, state_path, counts_path, keys, order, by, parts))
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def read_status_counts(spark: SparkSession, counts_path: str, as_of, by: Sequence[str] = (), new_days: int = NEW_LEAD_DAYS,
                       schema: T.StructType = CHANGES_SCHEMA) -> DataFrame:
    """The columns of ``operators.leads.status_counts`` on the day ``as_of``, from the stored differences alone."""
    kind = T.StructType([schema[b] for b in by] + [T.StructField("class", T.StringType()), T.StructField("created_date", T.DateType()),
                                                   T.StructField("n", T.LongType()), T.StructField("epoch", T.LongType())])
    d = spark.read.schema(kind).parquet(counts_path) if _exists(spark, counts_path) else spark.createDataFrame([], kind)
    fresh = F.coalesce(F.col("created_date") >= F.date_sub(as_of_date(as_of), new_days), F.lit(False))
    status = F.when((F.col("class") == "open") & fresh, "new").when(F.col("class") == "open", "active").otherwise(F.col("class"))
    d = d.withColumn("status", status)
    sums = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("new", "active", "won", "lost", "waiting")]
    return d.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *sums)
