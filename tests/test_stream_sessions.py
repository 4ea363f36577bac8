"""Sessions and activity from late, repeated and shuffled event files equal the batch report."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kpiforge.session import scratch_path
from kpiforge.sources import events as ev
from kpiforge.streaming import sessions as ss
from kpiforge.streaming.events import EVENTS_SCHEMA


def t(h, m=0, day=1, us=0):
    return dt.datetime(2024, 1, day, h, m, 0, us)


class Landing:
    """A landing folder and the two streams over it; each ``land`` is one micro-batch of either."""

    def __init__(self, spark, lateness="2 days"):
        self.spark, self.root, self.lateness = spark, scratch_path(spark, "sessions-test"), lateness

    def land(self, rows):
        df = self.spark.createDataFrame(rows, EVENTS_SCHEMA) if isinstance(rows, list) else rows
        df.write.mode("append").parquet(f"{self.root}/in")
        for start, name in ((ss.start_sessions, "sessions"), (ss.start_activity, "activity")):
            start(self.spark, f"{self.root}/in", f"{self.root}/{name}", f"{self.root}/ck-{name}", self.lateness).awaitTermination()

    def sessions(self):
        return ss.read_sessions(self.spark, f"{self.root}/sessions", f"{self.root}/ck-sessions")

    def report(self):
        return ss.read_daily_metrics(self.spark, f"{self.root}/sessions", f"{self.root}/ck-sessions", f"{self.root}/activity")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_late_events_merge_open_sessions_and_repeats_count_once(spark):
    la = Landing(spark)
    first = [(1, t(10), 1, "view", 1.0, None), (2, t(10, 50), 1, "view", 1.0, None), (3, t(23, 50), 2, "view", 1.0, None),
             (None, t(9), None, "view", 1.0, None), (4, t(9), None, "click", 1.0, None)]
    la.land(first)
    assert la.sessions().count() == 3 and la.sessions().where("closed").count() == 0
    second = [(5, t(10, 25), 1, "view", 1.0, None),                      # between two open sessions: they become one
              (6, t(0, 20, 2), 2, "view", 1.0, None),                    # exactly the gap after 23:50, over midnight
              (7, t(0, 50, 2, 1), 2, "purchase", 2.5, None)]             # a microsecond more than the gap
    la.land(second + first)                                              # the first file again
    got = {(r.user, r.start, r.last, r.events) for r in la.sessions().collect()}
    assert got == {(1, t(10), t(10, 50), 3), (2, t(23, 50), t(0, 20, 2), 2), (2, t(0, 50, 2, 1), t(0, 50, 2, 1), 1)}
    assert rows_of(la.report()) == rows_of(ev.daily_metrics(spark.createDataFrame(first + second, EVENTS_SCHEMA)))
    la.land([(8, t(8, 0, 9), 3, "view", 1.0, None)])                      # the watermark passes everything before
    assert la.sessions().where("closed").count() == 3 and la.sessions().where("not closed").count() == 1
    la.land([(9, t(12), 1, "view", 1.0, None)])                           # too late: dropped
    assert la.sessions().count() == 4
    daily = {r.date: r.events for r in ss.read_daily_events(spark, f"{la.root}/activity").collect()}
    assert daily == {dt.date(2024, 1, 1): 6, dt.date(2024, 1, 2): 2, dt.date(2024, 1, 9): 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_files_equal_batch(spark, sf_small, seed):
    e = spark.read.parquet(f"{sf_small}/events.parquet").where(F.dayofmonth("ts") <= 9).cache()
    la = Landing(spark, "30 days")
    order = [0, 1, 2]
    random.Random(seed).shuffle(order)
    for k in order:
        la.land(e.where(F.floor((F.dayofmonth("ts") - 1) / 3) == k))
    assert rows_of(la.report()) == rows_of(ev.daily_metrics(e))


def test_replayed_epoch_replaces_itself(spark):
    path = f"{scratch_path(spark, 'epoch-test')}/t"
    sink = ss._epoch_sink(path, lambda df: df)
    for epoch, n in ((0, 5), (1, 3), (1, 3), (0, 5)):
        sink(spark.range(n).withColumn("x", F.lit(epoch)), epoch)
    assert spark.read.parquet(path).count() == 8
