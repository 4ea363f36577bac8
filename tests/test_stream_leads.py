"""Counts over changing leads equal the counts of the final snapshot."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kpiforge.functions.status import lead_status
from kpiforge.operators.leads import status_counts
from kpiforge.schemas import LOST_STAGES, WAITING_STAGES, WON_STAGES
from kpiforge.session import scratch_path
from kpiforge.streaming import leads as sl

AS_OF = dt.date(2024, 3, 1)
STAGES = [WON_STAGES[0], LOST_STAGES[0], WAITING_STAGES[0], "Angebot", "Qualifizierung", None]
KIND = "tenant long, lead_id long, stage string, created_date date, seq long"


def final_counts(spark, rows, as_of, by=()):
    last = {}
    for r in rows:
        if (r[0], r[1]) not in last or last[r[0], r[1]][4] < r[4]:
            last[r[0], r[1]] = r
    df = spark.createDataFrame([r for r in last.values() if r[2] is not None], KIND)
    df = df.withColumn("status", lead_status(F.col("stage"), F.col("created_date"), as_of))
    return sorted(tuple(r) for r in status_counts(df, by).collect())


def changes(seed, n=300, leads=40):
    r = random.Random(seed)
    return [(r.randrange(3), r.randrange(leads), r.choice(STAGES), dt.date(2024, 2, 1) + dt.timedelta(r.randrange(40)) if r.random() < 0.9 else None, k)
            for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_and_replays_equal_final_snapshot(spark, seed):
    root, rows = scratch_path(spark, "leads-test"), changes(seed)
    order = rows[:]
    random.Random(seed).shuffle(order)                       # older changes come after newer ones
    for epoch, a in enumerate(range(0, len(order), 100)):
        df = spark.createDataFrame(order[a:a + 100], KIND)
        for _ in range(2 if epoch != 1 else 3):              # each batch is replayed
            sl.change_batch(df, epoch, f"{root}/state", f"{root}/counts", ["tenant", "lead_id"], by=["tenant"], parts=4)
    schema = spark.createDataFrame([], KIND).schema
    for as_of in (AS_OF, AS_OF + dt.timedelta(20)):          # the line between new and active moves with the day
        got = sl.read_status_counts(spark, f"{root}/counts", as_of, ["tenant"], schema=schema)
        assert sorted(tuple(r) for r in got.collect()) == final_counts(spark, rows, as_of, ["tenant"])


def test_a_move_changes_both_counts_and_touches_one_part(spark):
    root = scratch_path(spark, "leads-move-test")
    first = [(0, k, "Angebot", dt.date(2023, 1, 1), 1) for k in range(50)]
    run = lambda rows, e: sl.change_batch(spark.createDataFrame(rows, KIND).drop("tenant"), e, f"{root}/state", f"{root}/counts")
    run(first, 0)
    files = lambda: set(spark.read.parquet(f"{root}/state").inputFiles())
    before = files()
    run([(0, 7, WON_STAGES[0], dt.date(2023, 1, 1), 2)], 1)
    assert len(before - files()) == 1                         # every other part's file is as it was
    assert tuple(sl.read_status_counts(spark, f"{root}/counts", AS_OF).collect()[0]) == (50, 0, 49, 1, 0, 0)
    run([(0, 7, None, None, 3), (0, 7, "Angebot", None, 0)], 2)     # gone; an older change comes late
    assert tuple(sl.read_status_counts(spark, f"{root}/counts", AS_OF).collect()[0]) == (49, 0, 49, 0, 0, 0)
    d = {(r.epoch, r["class"]): r.n for r in spark.read.parquet(f"{root}/counts").collect()}
    assert d == {(0, "open"): 50, (1, "open"): -1, (1, "won"): 1, (2, "won"): -1}
    with pytest.raises(Exception, match="NULL in key column"):
        run([(0, None, "Angebot", None, 4)], 3)


def test_without_changes_there_are_zeros(spark):
    path = scratch_path(spark, "no-leads")
    assert tuple(sl.read_status_counts(spark, path, AS_OF).collect()[0]) == (0, 0, 0, 0, 0, 0)
