"""Operators that compare documents, against brute force."""
import collections
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import decontaminate, jaccard, lines, suffixes
from kpiforge.llm.components import components
from tests.llm.fixtures import documents, no_documents, odd_documents, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    where = collections.defaultdict(list)
    for i in ids:
        near = collections.Counter(j for x in sets[i] for j in where[x])
        for j, common in near.items():
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in sets[i]:
            where[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(base, n):
    """Chains of texts that change one word more each: neighbours link, ends don't."""
    w, out = base.split(), []
    for k in range(n):
        w = list(w)
        w[(k * 11) % len(w)] = f"changed{k}"
        out.append(" ".join(w))
    return out


def test_jaccard_matches_brute_force(spark, sf_small):
    given = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op3_ngram_jaccard_join(spark, sf_small).collect()}
    assert got == brute_components(given)


@pytest.mark.parametrize("open_share", [jaccard.OPEN_SHARE, 0])
def test_jaccard_chains_and_star_rounds(spark, monkeypatch, open_share):
    monkeypatch.setattr(jaccard, "OPEN_SHARE", open_share)    # 0: all star rounds come before the open pairs
    texts = [t for s in range(4) for t in near_copies(prose(s, 90), 9)] + [prose(50, 40)] * 5 + [prose(51, 7) + " " + prose(52, 9)]
    given = dict(enumerate(texts))
    got = jaccard.jaccard_classes(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(given)


def test_jaccard_odd_documents(spark):
    got = jaccard.jaccard_classes(odd_documents(spark)).collect()
    assert len(got) == 12                                     # the row without id is left out
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 0 == by[5].class_id and by[9].component_id == 9
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))
    assert by[4].n_shingles == 1
    assert jaccard.jaccard_classes(no_documents(spark)).count() == 0
    kept = jaccard.stage_jaccard(spark, odd_documents(spark), "")
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 9, 10]


def test_packed_sets_round_trip():
    x = np.unique(np.random.default_rng(7).integers(0, 1 << 63, 500, dtype=np.uint64)) << np.uint64(1)
    for s in (x, x[:1], x[:0]):
        assert (jaccard.unpack_set(jaccard.pack_set(s)) == s >> np.uint64(16) << np.uint64(16)).all()


def test_prefix_rows_travel_packed():
    rng = np.random.default_rng(3)
    h, c = rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    pos = rng.integers(0, 1 << 20, 5000).astype(np.int32)
    for k in (5000, 1, 0):
        lot = jaccard.pack_rows(h[:k], c[:k], pos[:k])
        assert len(lot) == jaccard.ROW_BYTES * k
        got = [x.tolist() for x in jaccard.unpack_rows(lot)]
        assert sorted(zip(*got)) == sorted(zip((h[:k] >> np.uint64(16)).tolist(), c[:k].tolist(), pos[:k].tolist()))


@pytest.mark.parametrize("lot_rows", [jaccard.LOT_ROWS, 50])
def test_shared_rows_of_lots_match_brute_force(spark, monkeypatch, lot_rows):
    monkeypatch.setattr(jaccard, "LOT_ROWS", lot_rows)
    texts = [t for s in range(3) for t in near_copies(prose(s, 90), 6)] + [prose(7, 60)] * 3 + [None, "", prose(8, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    sketch = np.zeros(1 << jaccard.SKETCH_BITS, np.uint32)
    rows = [tuple(r) for r in jaccard.prefix_rows(docs, sketch, 75).select("h", "cls", "pos").collect()]
    sets = {jaccard.set_class(s): s for s in jaccard.shingle_sets(jaccard.raw(texts)) if len(s)}
    low = {c: sorted((int(x) & (1 << 44) - 1, int(x) >> 16) for x in s)[:len(s) - -(-75 * len(s) // 100) + 1] for c, s in sets.items()}
    assert set(rows) == {(x, c, k) for c, v in low.items() for k, (_, x) in enumerate(v)}
    meets = collections.Counter(h for h, _, _ in set(rows))
    got = [tuple(r) for r in jaccard.shared_rows(jaccard.prefix_rows(docs, sketch, 75)).select("h", "cls", "pos").collect()]
    assert got and sorted(got) == sorted(x for x in set(rows) if meets[x[0]] > 1)


def test_shingles_with_one_hash_keep_the_first_place(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 10, 2), (1, 11, 4), (2, 10, 0), (2, 10, 1)], "h long, cls long, pos int").coalesce(1)
    got = sorted((r.h, r.cls, r.pos) for r in jaccard.shared_rows(rows).collect())
    assert got == [(1, 10, 2), (1, 11, 4)]


def test_jaccard_drops_the_sketches_before_the_prefixes(spark, monkeypatch):
    """The parts of the tasks' sketches are off the shared disk when prefix rows are made."""
    at, made = [], jaccard.prefix_rows
    monkeypatch.setattr(jaccard, "store", lambda df, name, f=jaccard.store: at.append((name, f(df, name))) or at[-1][1])

    def prefixes(*given):
        at.append(("there", [n for n, t in at if t.inputFiles() and os.path.exists(t.inputFiles()[0].removeprefix("file:"))]))
        return made(*given)

    monkeypatch.setattr(jaccard, "prefix_rows", prefixes)
    jaccard.jaccard_classes(spark.createDataFrame([(0, prose(1, 30)), (1, prose(1, 30))], "doc_id long, text string"))
    assert dict(at)["there"] == ["every"]


def test_filters_never_refuse_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)]))
        if len(y):
            common = len(np.intersect1d(x, y))
            assert jaccard.common_at_least(x, y, 75) == (100 * common >= 75 * (len(x) + len(y) - common))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, kept)
    return out


@pytest.mark.parametrize("shard_bytes,split", [(suffixes.SHARD_BYTES, suffixes.SPLIT), (5000, 2)])
def test_substrings_match_brute_force(spark, sf_small, shard_bytes, split):
    given = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    passage = prose(77, 40)
    given |= {1000 + k: prose(100 + k, 20) + passage[k:len(passage) - k % 5] + prose(300 + k, 15) for k in range(30)}
    given |= {2000: "ab" * 300, 2001: "ab" * 250 + "c", 2002: "x\x00" * 120}
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = suffixes.substring_dedup(df, shard_bytes=shard_bytes, split=split).collect()
    want = brute_repeats(given, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_substrings_odd_documents(spark):
    rows = suffixes.substring_dedup(odd_documents(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[5].n_removed == by[5].n_bytes and by[0].n_removed == 0
    assert by[9].n_removed == 0                                # a repeated row is no repeat of itself
    assert by[None].n_removed == 0
    assert (by[8].n_removed, by[8].n_spans) == (499, 1)
    assert suffixes.substring_dedup(no_documents(spark)).count() == 0


def test_op4_query_digests(spark, sf_small):
    want = {i: (n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in
            brute_repeats({r.doc_id: r.text for r in documents(spark, sf_small).collect()}, 100).items()}
    got = suffixes.op4_suffix_array_dedup(spark, sf_small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(2)
    for text in [b"", b"a", b"banana" * 30, bytes(rng.integers(0, 3, 500, dtype=np.uint8)), b"\x00" * 40]:
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            continue
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(data, order, np.array([0]), np.array([len(text)]), 50)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            n = 0
            while n < 50 and b + n < len(text) and a + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute_lines(texts, size=3):
    full = {i: [x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")] for i, t in texts.items()}
    full = {i: [x for x in v if x] for i, v in full.items()}
    seen, out = set(), {}
    for i in sorted(texts):
        v, gone = full[i], set()
        for p in range(len(v) - size + 1):
            w = tuple(v[p:p + size])
            if w in seen:
                gone.update(range(p, p + size))
            seen.add(w)
        out[i] = (len(gone), [x for k, x in enumerate(v) if k not in gone])
    return out


def test_lines_match_brute_force(spark, sf_small):
    given = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    given |= {9000 + k: f"head {k}\nA\n \nB\nC\nD\ntail {k}" for k in range(5)} | {9100: "u\nv\nu\nv\nu\nv\nu"}
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string").withColumn("id", F.lit(1))
    want = brute_lines(given)
    for r in lines.line_dedup(df).collect():
        left = [x.strip(" \t\n\v\f\r") for x in r.text.split("\n")]
        assert (r.line_dedup.n_removed, [x for x in left if x]) == want[r.doc_id]
        if not r.line_dedup.n_removed:
            assert r.text == given[r.doc_id]


def test_lines_odd_documents(spark):
    rows = lines.line_dedup(odd_documents(spark)).collect()
    assert len(rows) == 13 and not any(r.line_dedup.n_removed for r in rows)
    assert {r.doc_id: r.text for r in rows}[1] is None
    assert lines.line_dedup(no_documents(spark)).count() == 0


def clean_shingles(text):
    keep = str.maketrans(decontaminate.UPPER, decontaminate.UPPER.lower(), decontaminate.PUNCTUATION)
    w = [x for x in SPACE.split((text or "").translate(keep)) if x]
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute_contaminated(docs, items):
    out = {}
    for j, t in items.items():
        item = collections.Counter(clean_shingles(t))
        size = sum(item.values())
        for i, d in docs.items():
            s, best = clean_shingles(d), 0
            for a in range(max(1, len(s) - size + 1)) if size and s else []:
                w = s[a:a + size]
                if w[0] in item or w[len(w) // 2] in item or w[-1] in item:
                    common = sum((collections.Counter(w) & item).values())
                    best = max(best, common / (len(w) + size - common))
            if best >= 0.75:
                out[i, j] = best
    return out


def test_decontamination_matches_brute_force(spark, sf_small):
    docs = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()}
    for k in range(8):                                         # planted: other case, punctuation, a changed edge
        w = items[k].split()
        docs[5000 + k] = f"{prose(k, 30)} {' '.join(w[:-2]).upper()}!! {prose(k + 50, 2)} {prose(k + 90, 30)}"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b).collect()}
    want = brute_contaminated(docs, items)
    assert len(want) >= 8 and set(got) == set(want)
    for k, r in got.items():
        assert abs(r.similarity - want[k]) < 1e-12 and r.distance <= decontaminate.RADIUS


@pytest.mark.parametrize("words", [18, 31, 44])
def test_decontamination_of_split_and_short_documents(spark, words):
    """Hits further apart than an item, documents shorter than it, and an id with texts of both kinds."""
    item = prose(77, words)
    w, far = item.split(), prose(5, 60)
    docs = {0: f"{' '.join(w[:words // 2])} {far} {' '.join(w[words // 2:])}", 1: " ".join(w[:-1]), 2: " ".join(w[2:]),
            3: " ".join(w[:words // 2]), 4: f"{far} {item} {far} {' '.join(w[:9])}", 5: item + " one more"}
    for gap in range(1, words):                                # the halves drift apart word by word
        docs[10 + gap] = f"{' '.join(w[:gap])} {prose(gap, gap * 3)} {' '.join(w[gap:])}"
    rows = [*docs.items(), (1, far), (3, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in decontaminate.contaminated(d, b).collect()}
    want = {i: v for (i, _), v in brute_contaminated(docs, {1: item}).items()} | {3: 1.0}
    assert got.keys() == want.keys() and {1, 4, 5} <= got.keys() and 0 not in got
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_decontamination_misses_no_pair(spark):
    """Windows just above the least similarity: the block lookup's recall is whole within a radius of 23 bits."""
    items = {k: prose(k + 1000, 24 + k % 30) for k in range(60)}
    docs = {}
    for k, t in items.items():
        w = t.split()
        for cut in range(1, 8):                                # words changed at either edge
            docs[len(docs)] = f"{prose(k, 20)} {' '.join(w[cut:])} {prose(k + 90, 20)}"
            docs[len(docs)] = f"{prose(k, 20)} {' '.join(w[cut // 2:len(w) - cut + cut // 2])} {prose(k + 90, 20)}"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b).collect()}
    want = brute_contaminated(docs, items)
    assert len(want) > 300 and set(got) == set(want) and all(abs(got[k].similarity - want[k]) < 1e-12 for k in want)
    assert any(r.distance > 14 for r in got.values())


def test_block_probes_meet_all_fingerprints_in_radius(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    flips = [np.bitwise_xor.reduce([np.int64(1) << np.int64(b) for b in rng.choice(64, decontaminate.RADIUS, False)]) for _ in a]
    items = spark.createDataFrame([(i, 5, int(x)) for i, x in enumerate(a)], "item long, size int, item_sig long")
    listed = {(r.item, r.block, r.value) for r in decontaminate.probes(items, decontaminate.RADIUS, decontaminate.BLOCKS).collect()}
    for i, (x, f) in enumerate(zip(a, flips)):
        y = int(x ^ f) & ((1 << 64) - 1)
        assert any((i, k, y >> s & ((1 << w) - 1)) in listed for k, (s, w) in enumerate(decontaminate.block_layout()))


def test_decontamination_odd_input(spark):
    odd = odd_documents(spark)
    b = spark.createDataFrame([(1, prose(0, 30)), (2, None), (3, ""), (4, "one two"), (None, prose(9, 60)), (5, prose(9, 60)), (5, prose(9, 60))],
                              "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(odd, b).collect()}
    assert got == {(0, 1): (1.0, 0), (5, 1): (1.0, 0), (9, 5): (1.0, 0)}
    assert decontaminate.contaminated(no_documents(spark), b).count() == 0
    assert decontaminate.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_has_no_python(spark, sf_small):
    plan = decontaminate.op9_benchmark_decontamination(spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_texts_that_share_an_id(spark):
    """Lines are cut from, and groups are formed by, a text and not by whatever else has its id."""
    lines_ = "\n".join(prose(k, 8) for k in range(6))
    other = "\n".join(prose(k, 8) for k in range(50, 53))
    rows = [(0, lines_), (1, lines_), (1, other), (2, lines_ + "\n" + other), (None, lines_), (3, None)]
    names = ["cut", "spots", "version", "id", "_cut", "_spots", "line_dedup", "row", "quality"]
    d = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit(1).cast("long").alias("n_chars"), *[F.lit(c).alias(c) for c in names])
    got = lines.line_dedup(d, out="done")
    assert got.columns == [*d.columns, "done"]
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    want = [(0, lines_), (1, ""), (1, other), (2, ""), (None, lines_), (3, None)]
    assert kept == sorted(want, key=repr) and all(r[c] == c for r in got.collect() for c in names)
    assert lines.stage_lines(spark, d, None).columns == d.columns
    x, y = prose(1, 60), prose(2, 60)
    d = spark.createDataFrame([(0, x), (1, x), (1, y), (1, y), (2, y), (None, x)], "doc_id long, text string").withColumn("row", F.lit(0))
    left = jaccard.stage_jaccard(spark, d, None)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(0, x), (1, y), (1, y), (None, x)], key=repr)
