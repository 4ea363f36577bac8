"""Phrase collocations against brute force."""
import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import collocations as co
from tests.llm.fixtures import documents, no_documents, odd_documents, prose

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, best):
    f = collections.defaultdict(collections.Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                f[r.lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        gone = {p[i:i + m] for p, v in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if 100 * v >= 80 * c[p[i:i + m]]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows_[:best])]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_brute_force(spark, sf_small):
    got = found(co.op13_phrase_collocations(spark, sf_small))
    assert got == brute(documents(spark, sf_small).collect(), 30, 2000) and got


def test_sql_matches_brute_force(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    assert sorted(con.execute(co.ORACLE_SQL).fetchall()) == brute(documents(spark, sf_small).collect(), 30, 2000)


@pytest.mark.parametrize("words,phrases,block", [(1 << 20, 1 << 20, 1 << 20), (40, 1 << 20, 100), (1 << 20, 60, 5000)])
def test_shares_and_small_blocks(spark, sf_small, monkeypatch, words, phrases, block):
    monkeypatch.setattr(co, "MAX_WORDS", words)
    monkeypatch.setattr(co, "MAX_PHRASES", phrases)
    monkeypatch.setattr(co, "BLOCK", block)
    docs = documents(spark, sf_small).limit(40).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    assert found(co.collocations(docs, least=4, best=50)) == brute(docs.collect(), 4, 50)


def test_odd_documents(spark):
    docs = odd_documents(spark).withColumn("lang", F.when(F.col("doc_id") != 5, F.lit("é")))
    long_word = "x" * 5000
    more = spark.createDataFrame([(f"A b C. {long_word} b!a b c {long_word} b \t q\x1cz", "é")] * 4 + [("a b a b a b a b", "fr")], "text string, lang string")
    docs = docs.select("text", "lang", "id", "key" if "key" in docs.columns else F.lit(1).alias("key"), F.lit(2).alias("word"),
                       F.lit(3).alias("ids")).unionByName(more, allowMissingColumns=True)
    want = brute(docs.collect(), 3, 30)
    assert found(co.collocations(docs, least=3, best=30)) == want and any(long_word in r[2] for r in want)
    assert co.collocations(no_documents(spark)).count() == 0
    assert co.collocations(docs.limit(2)).count() == 0


def test_trie_accepts_its_phrases_and_no_others():
    r = np.random.default_rng(4)
    phrases = np.unique(np.minimum(r.geometric(0.002, (4000, 3)), 9000), axis=0).astype(np.int64)
    trie = co.Trie(phrases)
    assert len(np.unique(trie.accept)) == len(phrases)
    ids = np.append(np.minimum(r.geometric(0.002, 30000), 9000), 0).astype(np.int32)
    ids[::7] = 0
    ids[100:100 + 3 * 50] = phrases[:50].ravel()
    at, state = trie.advance(ids, 3)
    state_of = {tuple(p): s for p, s in zip(phrases.tolist(), trie.accept.tolist())}
    want = [(i, state_of[tuple(ids[i:i + 3].tolist())]) for i in range(len(ids) - 2) if tuple(ids[i:i + 3].tolist()) in state_of]
    assert list(zip(at.tolist(), state.tolist())) == want and len(want) >= 50


def test_scores_beyond_64_bits(spark):
    big = 40_000_000_000_000
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big + 1, 2)], "lang string, word string, f long, id long")
    pair = spark.createDataFrame([([1, 2], big - 1)], "ids array<int>, f long")
    r = co.scored([pair], words).collect()[0]
    assert r.score == 2000000 * (big - 1) // (2 * big + 1)
