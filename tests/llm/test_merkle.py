"""The Merkle manifest against a brute-force tree and its DuckDB SQL."""
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import merkle
from tests.llm.fixtures import no_documents, odd_documents

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(digests):
    """Root of a tree, and the runs (place in run, digests) on the way of each leaf."""
    ways = [[] for _ in digests]
    below, level = [[i] for i in range(len(digests))], digests
    while len(level) > 1:
        runs = [range(i, min(i + 3, len(level))) for i in range(0, len(level), 3)]
        for run in runs:
            for k, node in enumerate(run):
                for i in below[node]:
                    ways[i].append((k, [level[x] for x in run]))
        below, level = [[i for x in run for i in below[x]] for run in runs], [h(*[level[x] for x in run]) for run in runs]
    return level[0], ways


def brute(rows, tamper=True):
    sources = {}
    for r in rows:
        sources.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    trees = [sorted(sources[s], key=lambda x: x[:3]) for s in sorted(sources)]
    subs = [tree_of([x[2] for x in t]) for t in trees]
    root, top = tree_of([s[0] for s in subs])
    out = []
    for t, (subroot, ways), upper in zip(trees, subs, top):
        for (_, _, leaf, r), way in zip(t, ways):
            found, proof = leaf, ""
            if tamper and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None:
                found = leaf_of(r, r.text.replace("\n", ""))
            for k, run in way + upper:
                proof += "".join(run[:k] + run[k + 1:])
                found = h(*run[:k], found, *run[k + 1:])
            out.append((r.doc_id, leaf, subroot, root, h(proof), found, found == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [2, 7])
def test_manifest_matches_brute_force(spark, sf_small, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    df = merkle.op11_merkle_manifest(spark, sf_small)
    assert df.columns == NAMES and df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == brute(docs.collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("source", ["same", "own", "few"])
def test_trees_of_many_sizes(spark, monkeypatch, source):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    col = {"same": F.lit("s"), "own": F.col("id").cast("string"),
           "few": F.when(F.col("id") < 3, F.lit(None).cast("string")).when(F.col("id") < 4, "é").otherwise(F.concat(F.lit("s"), F.floor(F.sqrt("id"))))}[source]
    docs = spark.range(85).select(F.col("id").alias("doc_id"), col.alias("source"), F.lit("en").alias("lang"),
                                  F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("a\n"), "id").alias("text"))
    got = merkle.merkle_manifest(docs, tampered_digest=F.lit(None).cast("string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs.collect(), tamper=False)


def test_odd_documents(spark):
    docs = odd_documents(spark).withColumn("source", F.when(F.col("doc_id") > 4, F.lit("x")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang"))).withColumn(
        "n_chars", F.when(F.col("doc_id") != 4, F.col("n_chars")))
    for c in ["tree", "place", "way", "tampered", "block"]:
        docs = docs.withColumn(c, F.lit(1))
    got = sorted((tuple(r) for r in merkle.merkle_manifest(docs).collect()), key=repr)
    assert got == brute(docs.collect(), tamper=False) and all(r[-1] for r in got)
    assert merkle.merkle_manifest(no_documents(spark)).count() == 0


def test_manifest_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = con.execute(merkle.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, sf_small).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
