"""Operators on single texts: quality rules, licence scan, language id."""
import collections
import re
import textwrap

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import langid, licenses, repetition
from tests.llm.fixtures import documents, no_documents, odd_documents, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_quality(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), failed)


def test_quality_counts_match_brute_force(spark, sf_small):
    given = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    for r in repetition.op7_quality_rules(spark, sf_small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(given[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_odd_documents(spark):
    q = repetition.quality_rules(odd_documents(spark), out="q")
    assert q.columns[:-1] == odd_documents(spark).columns
    rows = q.collect()
    assert len(rows) == 13
    for r in rows:
        got = (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words, r.q.base_failed)
        assert got == brute_quality(r.text)
    assert repetition.quality_rules(no_documents(spark)).count() == 0


def test_coverage_of_each_length():
    text = prose(1, 100) + " " + prose(2, 8) + " " + prose(3, 50) + " " + prose(2, 8)
    m = repetition.measure([text, prose(4, 30)], [5, 8, 9])
    share = 2 * len("".join(words(prose(2, 8)))) / len("".join(words(text)))
    assert np.allclose(m["ngram_coverage"][0], [share, share, 0]) and not m["ngram_coverage"][1].any()


def brute_coverages(text):
    """Shares of word characters inside repeated n-grams for n = 5..10, and of characters inside repeated lines."""
    w = words(text)
    shares = []
    for n in range(5, 11):
        places = collections.defaultdict(list)
        for i in range(len(w) - n + 1):
            places[tuple(w[i:i + n])].append(i)
        inside = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + n)}
        shares.append(sum(len(w[j]) for j in inside) / max(1, sum(map(len, w))))
    seen, chars = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            chars += len(line) if line in seen else 0
            seen.add(line)
    return shares, chars / max(1, len(text or ""))


def test_quality_verdict_matches_brute_force(spark, sf_small):
    """The documents, and texts with a passage of 3 to 12 words or a line twice among 60 others."""
    made = [(10_000 + k, f"{prose(3 * k, 30)}{sep}{passage}{sep}{prose(3 * k + 1, 30)}{sep}{passage}")
            for k in range(40) for passage in [prose(3 * k + 2, k % 10 + 3)] for sep in [" ", "\n"][k % 2]]
    df = documents(spark, sf_small).select("doc_id", "text").unionByName(
        spark.createDataFrame(made, "doc_id long, text string"))
    only_method = []
    for r in repetition.quality_rules(df, out="q").collect():
        shares, lines = brute_coverages(r.text)
        assert np.allclose(r.q.ngram_coverage, shares) and np.isclose(r.q.line_coverage, lines)
        over = lines > 0.20 or any(s > 0.20 - 0.02 * k + 1e-12 for k, s in enumerate(shares))
        assert r.q.kept == (not brute_quality(r.text)[-1] and not over)
        if over and not r.q.base_failed:
            only_method.append(r.doc_id)
    assert {i for i in only_method if i >= 10_000}


def test_short_repeated_lines_are_rejected_by_line_coverage_alone(spark):
    """Four words between other words: no five-word window repeats, but the line does."""
    own = [" ".join(f"word{k}x{i}" for i in range(6)) for k in range(30)]
    text = "\n".join(f"{line}\nleave a comment below" for line in own)
    few = "\n".join(f"{line}\n{'leave a comment below' if k < 5 else k}" for k, line in enumerate(own))
    df = spark.createDataFrame([(1, text), (2, few)], "doc_id long, text string")
    q = {r.doc_id: r.q for r in repetition.quality_rules(df, out="q").collect()}
    assert not any(q[1].ngram_coverage) and not q[1].base_failed and q[1].line_coverage > 0.20 and not q[1].kept
    assert q[2].n_dup_lines == 4 and q[2].kept


def test_license_scan_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = sorted(con.execute(licenses.ORACLE_SQL).fetchall())
    got = sorted((r.doc_id, r.digest, r.n_words, r.license) for r in licenses.op8_license_scans(spark, sf_small).collect())
    assert got == want


def test_license_variants(spark):
    mit = licenses.KNOWN_LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2024 Someone\n\n" + mit.upper().replace('"', "“"), mit.replace("sublicense", "sub-licence"),
             mit + " And more.", None, "", "© Someone", mit.replace("\n", "\r\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS digest")
    got = {r.doc_id: r.scan for r in licenses.license_scan(df, licenses.known_licenses(spark)).collect()}
    assert [got[i].license for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT"]
    assert got[4].digest is None and got[5].n_words == got[6].n_words == 0


def test_license_scan_does_not_depend_on_wrapping(spark):
    heads = ["", "Copyright (c) 2024 Someone\n\n", "Copyright 2019-2024 The Regents of the University.\nAll rights reserved.\n\n",
             "COPYRIGHT SOMEONE\n", "© Someone\r\n(c) 2020 Other, Inc.\r\n"]
    titles = {"MIT": "The MIT License (MIT)\n\n", "ISC": "ISC License\n\n", "BSD-2-Clause": "BSD 2-Clause License\n",
              "BSD-3-Clause": "BSD 3-Clause License\n\n", "Zlib": "zlib License\n\n"}
    texts = []
    for name, known in licenses.KNOWN_LICENSES.items():
        for width in (20, 33, 47, 64, 72, 76, 78, 80, 100, 1_000_000):
            body = textwrap.fill(known, width, break_long_words=False, break_on_hyphens=False)
            texts += [(name, titles.get(name, "") + h + body) for h in heads]
        texts.append((name, f"{titles.get(name, '')}Copyright (c) 2024 Some One {known}".replace("\n", " ")))
        texts.append((name, f"{titles.get(name, '')}Copyright (c) 2024 The Some\nOne Foundation\n{known}"))
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "doc_id long, name string, text string")
    rows = licenses.license_scan(df, licenses.known_licenses(spark)).collect()
    assert [r.text for r in rows if r.scan.license != r.name] == [] and len(rows) == len(texts)
    assert len({(r.scan.digest, r.scan.n_words) for r in rows}) == len(licenses.KNOWN_LICENSES)


def test_license_scan_keeps_words_after_copyright(spark):
    texts = {"Copyright law protects authors.": 4, "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM": 7, "One line.\ncopyright is another": 5,
             "Copyright Law in Europe\nis old": 6, "(c) the licensee pays": 4, "MIT License": 2, "\n" * 20000 + "a\nb": 2, "MIT License\nis a name": 5,
             "Copyright (c) 2024 Someone " + "word " * 100: 104, "Copyright (c) 2024 Someone\nand a poem": 3, "All rights reserved.\nTwo words": 2,
             "Two words\nAll rights reserved.": 2, "Copyright (c) 2024 Someone": 0, "Copyright (c) 1 " * 3000: 9000, "\n(c) 2024 A" * 3000: 8850}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.scan.n_words for r in licenses.license_scan(df, licenses.known_licenses(spark)).collect()}
    assert got == texts


def test_license_scan_has_no_python(spark, sf_small):
    plan = licenses.op8_license_scans(spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_language_held_out_accuracy(spark, sf_small):
    lang = {r.doc_id: (r.lang, r.text) for r in documents(spark, sf_small).collect()}
    rows = [r for r in langid.op1_language_id(spark, sf_small).collect()]
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and len(lang[r.doc_id][1]) > 200]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_documents(spark):
    model = langid.fit(odd_documents(spark))
    got = odd_documents(spark).select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()
    assert len(got) == 13
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.p.lang, r.p.score) == ("und", 0.0)
    empty = langid.fit(no_documents(spark))
    assert odd_documents(spark).select(langid.predict(F.col("text"), empty).alias("p")).filter("p.lang <> 'und'").count() == 0


def test_language_logits_are_the_vector_product():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, 0.2]), 1.5)
    texts = ["Hello there", "x", "Größe und Maß " * 20]
    _, score = langid.predict_block(texts, model)
    for t, s in zip(texts, score):
        c = langid.counts_of(t)
        p = langid.softmax((c @ model.table / c.sum() + model.bias) / 1.5)
        assert abs(p.max() - s) < 1e-5


def test_language_prediction_in_slices(monkeypatch):
    """Slices of any size, shorter than an n-gram or across several texts, give the same scores."""
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.zeros(3))
    texts = ["x", "Hello there", "yz", "Größe und Maß " * 30, "中"]
    want = langid.predict_block(texts, model)
    for values in (1, 3, 6, 9, 21, 64, 333):
        monkeypatch.setattr(langid, "SLICE_VALUES", values)
        got = langid.predict_block(texts, model)
        assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_language_sample_is_bounded_in_all(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 10}") for i in range(2000)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 100)
    n = langid.training_rows(df, "doc_id", "lang", 400).count()
    assert 50 < n < 160


def test_ftrl_is_sparse_and_temperature_sharpens():
    rows = [("a", np.array([1, 2]), np.array([0.5, 0.5])), ("b", np.array([3, 2]), np.array([0.5, 0.5]))] * 40
    w, _ = langid.fit_ftrl(rows, ["a", "b"], np.ones(langid.BUCKETS), langid.Settings())
    assert w[1, 0] > 0 > w[1, 1] and not w[5].any()
    logits = np.array([[2.0, 0], [0, 2.0]] * 20)
    assert langid.fit_temperature(logits, np.array([0, 1] * 20)) < 1
