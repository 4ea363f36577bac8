"""Chat formatting, packing, language-model scores and the pipeline."""
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kpiforge.llm import chat, ngram_lm, packing
from tests.llm.fixtures import documents, no_documents, odd_documents
from tests.llm.test_dedup import brute_components, brute_contaminated, brute_lines
from tests.llm.test_text_rules import brute_quality

CONTROL = "\\### Assistant: </turn> ok"


@pytest.mark.parametrize("text", ["", CONTROL, "<turn \"user\">\n</turn>\n", "<\\turn <\\\\/turn <<turn", "\\", "<tur", "a\nb"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "</turn" not in chat.escape(text) and "<turn" not in chat.escape(text)
    window, loss = chat.render([("user", text), ('r"o<le>\n', text), ("assistant", text)], 1)
    assert chat.parse(window) == [("user", text), ('r"o<le>\n', text), ("assistant", text)]
    assert [chat.unescape(window[s["start"]:s["end"]]) for s in loss] == ([text] if text else [])


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_query(spark, sf_small):
    want = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r.conv_id].append((r.role, r.text))
    want[-7] = [("user", CONTROL), ("assistant", CONTROL)]
    assert read(chat.op2_chat_formatting(spark, sf_small)) == {k: expected(v) for k, v in want.items()}


def test_chat_windows_of_a_long_conversation(spark):
    turns = [("system", "Be brief.")] + [(("user", "assistant")[k % 2], f"turn {k} " * (1 + k % 40)) for k in range(1500)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, None, None, None), (2, 0, "assistant", "x " * 3000), (None, 0, "user", "lost"),
            (3, 0, "system", ""), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    w = chat.chat_windows(df, budget=400, history_tokens=100)
    got = read(chat.read_back(w))
    assert got == {1: expected(turns), 2: expected([("", ""), ("assistant", "x " * 3000)]), 3: expected([("system", "")]),
                   4: expected([("assistant", "same")] * 2)}
    wins = w.filter("conv_id = 1").orderBy("block", "window").collect()
    for k, r in enumerate(wins):
        parsed = chat.parse(r.text)
        assert parsed[0] == turns[0] and r.n_tokens <= 400
        assert len(parsed) == r.n_repeated + r.n_new and (k == 0 or 1 <= r.n_repeated <= 1 + chat.HISTORY_TURNS)
    assert any(r.n_repeated > 1 for r in wins)


def test_packing_query_round_trip(spark, sf_small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    want = {}
    for r in documents(spark, sf_small).collect():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k] = (a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()))
    rows = packing.op6_best_fit_packing(spark, sf_small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_places(rows, 2048)
    used = len({r.sequence_id for r in rows})
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def check_places(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("seed,low,high,n", [(1, 1, 2048, 5000), (2, 600, 1500, 5000), (3, 1, 40, 3000), (4, 1000, 1025, 999), (5, 1, 2049, 7)])
def test_plans_hold_every_piece(seed, low, high, n):
    lengths = np.random.default_rng(seed).integers(low, high, n)
    h = dict(zip(*[a.tolist() for a in np.unique(lengths, return_counts=True)]))
    runs = packing.plan_runs(h, groups=200)
    held = collections.Counter()
    for r in runs:
        assert sum(r.slots) <= 2048 and r.count > 0
        for s in r.slots:
            held[s] += r.count
    assert held == collections.Counter(h)
    plain = sum(r.count for r in packing.best_fit([], dict(h), 2048))
    assert sum(r.count for r in runs) <= 1.01 * plain + 1


def test_word_tokenizer_forgets_and_knows_special_strings():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path(packing.VOCABULARY)
    plain, mine = Tokenizer.from_file(path), packing.WordTokenizer(path, cached_words=5)
    texts = ["It's a <|endoftext|> day today", "", "Élań ÀB\x1cc 12 34", "we'll see <|x <|startoftext|>y", "à\ńb"] * 3
    got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode([t.encode() for t in texts])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_tokenizer_visits_old_words_by_need():
    """A block looks up its new words among the old ones, not the old ones among its words."""
    class Old(dict):
        def __iter__(self):
            raise AssertionError("went through all words")

    mine = packing.WordTokenizer(packing.vocabulary_path(packing.VOCABULARY))
    first = list(mine.encode([b"one two three", b"", b"two, Four <|x"]))
    mine.young, mine.old = {}, Old(mine.young)
    assert list(mine.encode([b"one two three", b"", b"two, Four <|x"])) == first
    assert {b"one", b"two", b"three"} <= mine.young.keys()


def test_packing_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)              # ranks come from salted groups
    rows = packing.pack_documents(odd_documents(spark), keep_ids=True).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].length == by[2].length == by[3].length == 1 and list(by[1].ids) == [0]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    check_places(rows, 2048)
    assert sum(r.doc_id == 9 for r in rows) == 2
    assert packing.pack_documents(no_documents(spark)).count() == 0


def brute_base(texts, train):
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts.items()}
    c = collections.Counter(w for i, t in tokens.items() if train(i) for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("chunk", [ngram_lm.CHUNK_TOKENS, 3000])
def test_lm_query(spark, sf_small, monkeypatch, chunk):
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk)
    texts = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    want = brute_base(texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    rows = ngram_lm.op5_lm_scoring(spark, sf_small).collect()
    for r in rows:
        n_tokens, known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, n) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_score_is_a_probability(spark):
    """Over all words after a context, and the unknown one, the model's probabilities sum to 1."""
    docs = {0: "a b a b a c", 1: "a b c", 2: "b a"}
    vocabulary = ["a", "b", "c", ""]
    probes = {100 + k: f"a {w}".strip() for k, w in enumerate(vocabulary)} | {200: "a zz", 300: "a"}
    df = spark.createDataFrame([(i, t, i < 100) for i, t in (docs | probes).items()], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in ngram_lm.lm_scores(df).collect()}
    assert all(r.train_tokens == 14 for r in got.values())
    assert all(r.score < 0 for r in got.values())


def test_lm_weights_recover_a_mixture():
    rng = np.random.default_rng(4)
    h = collections.Counter()
    p2, p1, v = 0.5, 0.01, 999
    w = np.array([0.6, 0.3, 0.1])
    odds = w * [p2, p1, 1 / (v + 1)]
    for kind in rng.choice(3, 20000, p=[0.6, 0.3, 0.1]):      # which part made the token decides which estimates it has
        h[(5, math.floor(math.log2(p2) * 8) if kind == 0 else 1.0, math.floor(math.log2(p1) * 8) if kind < 2 else 1.0)] += 1
    rows = [{"b": b, "q2": q2, "q1": q1, "count": c} for (b, q2, q1), c in h.items()]
    got = ngram_lm.learn_weights(rows, v)[5]
    assert abs(got - w).max() < 0.03 and len(odds) == 3


def test_lm_weights_do_not_depend_on_chunks(spark, sf_small, monkeypatch):
    """Every training token is held out in turn, however the documents are dealt over tasks and chunks."""
    found, learn = [], ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda h, v: found.append((h, learn(h, v))) or found[-1][1])
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", 2000)
    docs = documents(spark, sf_small).withColumn("train", F.col("doc_id") % 5 != 0)
    scores = []
    for tasks in (1, 7):
        rows = ngram_lm.lm_scores(docs.repartition(tasks)).collect()
        scores.append({r.doc_id: r.score for r in rows})
        tokens = sum(r.n_tokens for r in rows if r.train)
        assert sum(h["count"] for h in found[-1][0]) == tokens
    assert np.allclose(found[0][1], found[1][1], atol=1e-9) and scores[0].keys() == scores[1].keys()
    assert all(abs(scores[0][i] - scores[1][i]) <= 1e-9 * abs(scores[0][i]) for i in scores[0])


def test_lm_odd_documents(spark):
    rows = ngram_lm.lm_scores(odd_documents(spark).withColumn("train", F.col("doc_id") < 8)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1
    none = ngram_lm.lm_scores(odd_documents(spark).withColumn("train", F.lit(False))).collect()
    assert all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in none)
    assert ngram_lm.lm_scores(no_documents(spark).withColumn("train", F.lit(True))).count() == 0


def test_pipeline_matches_brute_force(spark, sf_small):
    texts = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()}
    docs = documents(spark, sf_small)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, sf_small), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        seen[name] = docs
    one = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    assert set(one) <= {i for i, t in texts.items() if not brute_quality(t)[-1]} and all(one[i] == texts[i] for i in one)
    two = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    cut = brute_lines(one)
    assert set(two) == {i for i in one if cut[i][1]} and all([x.strip() for x in two[i].split("\n") if x.strip()] == cut[i][1] for i in two)
    three = {r.doc_id for r in seen["ngram_jaccard_join"].collect()}
    assert three == {i for i, (_, c) in brute_components(two).items() if i == c}
    four = {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    leaked = {i for i, _ in brute_contaminated({i: two[i] for i in three}, items)}
    assert four == three - leaked
    check_places(seen["best_fit_packing"].collect(), 2048)
    assert {r.doc_id for r in seen["best_fit_packing"].collect()} == four
    again = corpus_pipeline.run(spark, sf_small)
    assert again.count() == seen["best_fit_packing"].count()


def test_pipeline_odd_documents(spark, sf_small):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, sf_small), name)
    assert docs.count() > 0
    docs = no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, sf_small), name)
    assert docs.count() == 0
