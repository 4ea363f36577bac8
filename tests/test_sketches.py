"""Stored distinct-count sketches: measured errors, replays, late days, groups, odd input."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import sketches
from kpiforge.session import scratch_path


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def users(spark, n_days, per_day, shared):
    """``per_day`` users a day of which ``shared`` come every day."""
    x = F.explode(F.sequence(F.lit(0), F.lit(per_day - 1)))
    df = spark.range(n_days).select(F.col("id").cast("int").alias("d"), x.alias("k"))
    user = F.when(F.col("k") < shared, F.col("k")).otherwise(F.col("d") * per_day + F.col("k")).cast("bigint")
    return df.select(user.alias("user"), F.date_add(F.lit(day(0)), F.col("d")).alias("date"))


@pytest.mark.parametrize("lg", [10, 14])
def test_measured_errors_are_within_the_bound(spark, lg):
    """Up to 90,000 distinct users, far above the size of exact small sketches."""
    df, path = users(spark, 60, 2000, 500), scratch_path(spark, "sketch-test")
    sketches.merge_sketches(spark, path, sketches.daily_sketches(df, "user", "date", lg_config_k=lg))
    stored = sketches.read_sketches(spark, path)
    monthly = {r.month: r.n_distinct for r in sketches.distinct_by_month(stored).collect()}
    exact = {"2024-01": 500 + 31 * 1500, "2024-02": 500 + 29 * 1500}
    errors = [abs(monthly[m] - exact[m]) / exact[m] for m in exact]
    trailing = {r.date: r.n_distinct for r in sketches.trailing_distinct(stored, 30).collect()}
    errors += [abs(trailing[day(n)] - (500 + 1500 * min(30, n + 1))) / (500 + 1500 * min(30, n + 1)) for n in range(60)]
    assert len(trailing) == 60 and 0 < max(errors) <= sketches.error_bound(lg)
    side = sketches.compare(spark.createDataFrame([("2024-01", 47000), ("2024-02", 1)], "month string, n long"),
                            sketches.distinct_by_month(stored, out="a"), ["month"], "n", "a", lg)
    assert {r.month: r.within_bound for r in side.collect()} == {"2024-01": True, "2024-02": False}


def table_rows(spark, path, by=()):
    s = sketches.read_sketches(spark, path).select(*by, "month", "date", F.hll_sketch_estimate("sketch").alias("n"))
    return sorted(map(tuple, s.collect()), key=repr)


def test_replay_and_late_events(spark):
    df, path = users(spark, 70, 40, 10), scratch_path(spark, "sketch-replay")
    late = (F.col("date") == day(5)) & (F.col("user") % 2 == 0)
    first = sketches.daily_sketches(df.where(~late), "user", "date")
    assert {r.month for r in sketches.merge_sketches(spark, path, first).collect()} == {"2024-01", "2024-02", "2024-03"}
    before = table_rows(spark, path)
    sketches.merge_sketches(spark, path, first)
    assert table_rows(spark, path) == before
    files = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    touched = sketches.merge_sketches(spark, path, sketches.daily_sketches(df.where(late), "user", "date"))
    assert [r.month for r in touched.collect()] == ["2024-01"]
    left = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f for f in files if "month=2024-01" not in f} == {f for f in left if "month=2024-01" not in f}
    assert [r[-1] for r in table_rows(spark, path)] == [40] * 70


def test_groups_nulls_and_gaps(spark):
    rows = [("a", 1, day(0)), ("a", 1, day(0)), ("a", 2, day(3)), (None, 7, day(1)), (None, None, day(2)), ("b", None, day(40))]
    df, path = spark.createDataFrame(rows, "g string, user long, date date"), scratch_path(spark, "sketch-groups")
    sketches.merge_sketches(spark, path, sketches.daily_sketches(df, "user", "date", ["g"]), ["g"])
    sketches.merge_sketches(spark, path, sketches.daily_sketches(df.limit(0), "user", "date", ["g"]), ["g"])
    assert table_rows(spark, path, ["g"]) == sorted([("a", "2024-01", day(0), 1), ("a", "2024-01", day(3), 1), (None, "2024-01", day(1), 1),
                                                     (None, "2024-01", day(2), 0), ("b", "2024-02", day(40), 0)], key=repr)
    t = {(r.g, r.date): r.n_distinct for r in sketches.trailing_distinct(sketches.read_sketches(spark, path), 3, ["g"]).collect()}
    assert t == {("a", day(0)): 1, ("a", day(1)): 1, ("a", day(2)): 1, ("a", day(3)): 1, (None, day(1)): 1, (None, day(2)): 1, ("b", day(40)): 0}


def test_a_null_date_fails(spark):
    df = spark.createDataFrame([(1, None)], "user long, date date")
    with pytest.raises(Exception, match="NULL in key column"):
        sketches.merge_sketches(spark, scratch_path(spark, "sketch-null"), sketches.daily_sketches(df, "user", "date"))
