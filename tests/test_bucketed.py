"""Bucketed fact tables: no exchange of the stored side, untouched files stay."""
import re
import uuid

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import bucketed as bk
from kpiforge.operators import facts
from kpiforge.plans import base
from kpiforge.session import scratch_path


@pytest.fixture
def table(spark, sf_small):
    daily = base.daily_from_orders(spark, sf_small, tenants=True)
    name = f"facts_{uuid.uuid4().hex[:8]}"
    bk.fact_table(spark, name, scratch_path(spark, name), daily.schema, ["tenant"], 8)
    yield name, daily
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(spark, name):
    return spark.table(name).drop("month", "bucket")


def test_upserts_equal_the_merge(spark, table):
    name, daily = table
    existing, updates = base.tenant_upsert_inputs(daily)
    first = existing.dropDuplicates(["tenant", "date"])
    bk.upsert_bucketed(spark, name, first, ["tenant", "date"])
    assert rows_of(plain(spark, name)) == rows_of(facts.upsert(first.limit(0), first, ["tenant", "date"]))
    for _ in range(2):                                              # the second changes nothing
        stored, _ = facts.staged(plain(spark, name), "copy")
        want = rows_of(facts.upsert(stored, updates, ["tenant", "date"]))
        bk.upsert_bucketed(spark, name, updates, ["tenant", "date"])
        assert rows_of(plain(spark, name)) == want


def test_one_tenant_leaves_other_files_and_the_stored_side_unshuffled(spark, table):
    name, daily = table
    bk.upsert_bucketed(spark, name, daily, ["tenant", "date"])
    files = lambda: set(spark.table(name).inputFiles())
    before = files()
    one = daily.where("tenant = 1").orderBy("date").limit(1)
    one = spark.createDataFrame(one.collect(), daily.schema).withColumn("seq", F.col("seq") + 1)
    places = bk.upsert_bucketed(spark, name, one, ["tenant", "date"])
    assert places.count() == 1
    place = places.first()
    gone = before - files()
    assert gone and all(f"month={place.month}/bucket={place.bucket}/" in f for f in gone)
    assert all(f"bucket={place.bucket}/" in f and f"month={place.month}/" in f for f in files() - before)
    spark.conf.set(bk.SUBSET_JOIN, "false")
    try:
        plan = bk.merged_rows(spark, name, one, places, ["tenant", "date"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(bk.SUBSET_JOIN)
    scan = plan.index("FileScan parquet")
    stored = plan[:scan][plan[:scan].rindex("FullOuter"):]           # from the join down to the stored side's scan
    assert "Exchange hashpartitioning" not in stored and "Bucketed: true" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the updates: one row per key, then to the buckets
    assert re.search(r"PartitionFilters: \[.*month.*bucket", plan)


def test_bucket_columns_must_be_keys(spark, table):
    with pytest.raises(ValueError, match="among the keys"):
        bk.upsert_bucketed(spark, table[0], table[1], ["date"])
    assert bk.upsert_bucketed(spark, table[0], table[1].limit(0), ["tenant", "date"]).count() == 0
