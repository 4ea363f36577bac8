"""Landed page chains with repeated, missing and trailing pages."""
import os
import random

import pytest
from pyspark.sql import functions as F

from kpiforge.sources import chains


def numbered(spark, rows):
    return spark.createDataFrame(rows, "run string, page long, more boolean, seq int, data string")


def test_numbered_chain(spark):
    rows = [("a", 1, True, 1, "x"), ("a", 2, True, 1, "old"), ("a", 2, True, 2, "new"), ("a", 3, False, 1, "end"), ("a", 4, True, 1, "late"),
            ("a", 5, False, 1, "late"),                                   # behind the end
            ("b", 1, True, 1, "x"), ("b", 3, True, 1, "z"), ("b", 3, True, 1, "z"), ("b", 7, None, 1, "w"),     # 2 and 4 to 6 are missing
            ("c", 2, True, 1, "x"), ("c", 3, True, 1, "y"),               # neither start nor end
            ("d", None, True, 1, "?"), ("d", 0, False, 1, "?")]           # nothing that counts
    p = numbered(spark, rows)
    kept, report = chains.numbered_chain(p, F.col("page"), F.col("more"), by=["run"], order=["seq"])
    assert kept.columns == p.columns
    assert sorted((r.run, r.page, r.data) for r in kept.collect()) == [
        ("a", 1, "x"), ("a", 2, "new"), ("a", 3, "end"), ("b", 1, "x"), ("b", 3, "z"), ("b", 7, "w"), ("c", 2, "x"), ("c", 3, "y")]
    assert sorted(tuple(r) for r in report.collect()) == [
        ("a", 6, 1, 2, 0, True), ("b", 4, 1, 0, 4, False), ("c", 2, 0, 0, 1, False), ("d", 2, 0, 2, 0, False)]
    gaps = chains.missing_pages(p, F.col("page"), F.col("more"), by=["run"])
    assert sorted(tuple(r) for r in gaps.collect()) == [("b", 2, 2), ("b", 4, 6), ("c", 1, 1)]
    one, rep = chains.numbered_chain(p.where("run = 'a'"), F.col("page"), F.col("more"), order=["seq"])
    assert one.count() == 3 and tuple(rep.collect()[0]) == (6, 1, 2, 0, True)


def walk(rows):
    """Brute force: (kept cursors, missing) of one chain of (cursor, next, more)."""
    at = {}
    for c, n, m in rows:
        at.setdefault(c, (n, m))
    head, c = [], None
    while c in at and c not in head:
        head.append(c)
        n, m = at[c]
        if not m or n is None:
            break
        c = n
    ended = bool(head) and not at[head[-1]][1]
    kept = set(head) if ended else set(at)
    breaks = sum(1 for c in kept if at[c][1] and at[c][0] not in at)
    return kept, breaks + (None not in at)


@pytest.mark.parametrize("gone,twice,trailing", [((), (), 0), ((4,), (2,), 0), ((0,), (), 0), ((3, 9), (1, 5), 0), ((), (3,), 4), ((11,), (), 0)])
def test_cursor_chain(spark, gone, twice, trailing):
    name = lambda k: None if k == 0 else f"c{k}"
    rows = [(name(k), name(k + 1) if k < 11 else None, k < 11) for k in range(12) if k not in gone]
    rows += [r for r in rows if r[0] in {name(k) for k in twice}]
    rows += [(f"t{k}", f"t{k + 1}" if k + 1 < trailing else None, k + 1 < trailing) for k in range(trailing)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "cursor string, next string, more boolean")
    kept, report = chains.cursor_chain(df, F.col("cursor"), F.col("next"), F.col("more"))
    want, missing = walk(rows)
    assert {r.cursor for r in kept.collect()} == want and kept.count() == len(want)
    assert tuple(report.collect()[0]) == (len(rows), len(twice), trailing, missing, missing == 0)


def test_cursor_chains_side_by_side(spark):
    rows = [("a", None, "x", True), ("a", "x", None, False), ("b", None, "x", True), ("b", "y", None, False), ("c", None, None, True)]
    df = spark.createDataFrame(rows, "run string, cursor string, next string, more boolean")
    kept, report = chains.cursor_chain(df, F.col("cursor"), F.col("next"), F.col("more"), by=["run"])
    assert kept.count() == 5
    assert sorted(tuple(r) for r in report.collect()) == [("a", 2, 0, 0, 0, True), ("b", 2, 0, 0, 1, False), ("c", 1, 0, 0, 1, False)]


def test_only_repeated_responses_are_stored(spark, monkeypatch):
    """Contents of a chain move where a response is repeated, and stay where they are otherwise."""
    stored = []

    def noted(df, name):
        got, path = staged(df, name)
        if "data" in got.columns:
            stored.append(got.count())
        return got, path

    staged = chains.staged
    monkeypatch.setattr(chains, "staged", noted)
    rows = [("a", f"c{k}" if k else None, f"c{k + 1}", k < 39, f"page {k}") for k in range(40)]
    rows += [rows[3], rows[7], rows[7], ("a", "t1", None, False, "stray"), (None, "c5", "c6", True, "of no run")]
    rows += [("b", None, "x", True, "old"), ("b", None, None, False, "new"), ("b", "x", None, False, "end")]
    df = spark.createDataFrame(rows, "run string, cursor string, next string, more boolean, data string")
    kept, report = chains.cursor_chain(df, F.col("cursor"), F.col("next"), F.col("more"), by=["run"])
    assert stored == [3]                                                  # c3 and c7 of a, the first of b
    got = sorted((r.run, r.data) for r in kept.collect())
    assert [d for r, d in got if r == "a"] == sorted(f"page {k}" for k in range(40))
    assert len([r for r, _ in got if r == "b"]) in (1, 2) and {r for r, _ in got} == {"a", "b"}
    assert tuple(report.where("run = 'a'").collect()[0]) == ("a", 44, 3, 1, 0, True)


def test_landed_pages_are_compressed(spark):
    """Landed documents take less room than their text, and no file holds more than a task should read."""
    from kpiforge.plans import catalog

    docs = spark.range(3 * catalog.LANDED_DOCS).coalesce(1).select(
        F.concat(F.lit('{"id":"property page number '), "id", F.lit('"}')).alias("doc"))
    got = catalog._read_pages(spark, docs, "landing", "id string")
    files = got.inputFiles()
    assert got.count() == 3 * catalog.LANDED_DOCS and got.select("id").distinct().count() == 3 * catalog.LANDED_DOCS
    assert len(files) == 3 and all(f.endswith(".snappy") for f in files)
    size = sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files)
    assert 2 * size < docs.agg(F.sum(F.length("doc") + 1)).first()[0]
