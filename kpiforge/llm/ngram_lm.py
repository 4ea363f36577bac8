"""Language-model scores by deleted interpolation.

P(w | v) mixes three estimates: the bigram's c(v,w)/c(v), the unigram's c(w)/N
and a uniform 1/(V+1). The weights depend on the bucket of the context's count
(powers of two) and are learned by expectation-maximisation on held-out counts:
each training token is held out of the counts in turn (its own occurrence is
deleted from them).

How counts reach the texts without a row per token: a task turns documents
into chunks of some ``CHUNK_TOKENS`` tokens (word numbers, word hashes) and
sends each chunk's distinct unigram and bigram keys, with their training
counts, to buckets by hash range. A bucket adds up and answers each chunk with
the corpus counts of its keys, in the order sent. A chunk meets its answers in
one task. Every corpus count covers all training documents; what is shuffled
grows with the input. Keys are 64-bit hashes (unigrams), and 48 bits within a
bucket (bigrams). Only N, V and a histogram with a bounded number of bins reach
the driver.

Special input: a null or empty text is the end token alone; rows with a null id
are scored, and learned from if ``train`` holds; repeated rows count as often
as they occur; without training rows both scores are 0; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm.common import mix64, release, segment_sums, store_split, table

CHUNK_TOKENS = 800_000
#: Characters of text for one bucket of counts, and most buckets.
BUCKET_CHARS, MAX_BUCKETS = 4 << 20, 1 << 14
CONTEXT_BUCKETS = 32
QUANTA = 8                  # bins per factor of two in the histogram of estimates
EM_ROUNDS = 60
END, BEGIN = 0, 1           # numbers of the end token and of the context of a first word
_END_HASH, _BEGIN_HASH = np.uint64(0x3C79AC492BA7B653), np.uint64(0x1C69B3F74AC4AE35)
_LOW48 = np.uint64((1 << 48) - 1)

CHUNK = ("kind string, chunk string, bucket int, ids array<long>, lens array<int>, train array<boolean>, "
         "tokens binary, vocab binary, keys1 binary, counts1 binary, keys2 binary, counts2 binary")
CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first (zero planes then shrink to nothing), compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size, b = np.dtype(kind).itemsize, zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def deltas(sorted_keys: np.ndarray) -> bytes:
    return planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by range of the hash."""
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


class Chunk:
    """Tokens of a run of documents, and their n-grams in the order in which counts are asked for."""

    def __init__(self, tokens: np.ndarray, lens: np.ndarray, vocab: np.ndarray, buckets: int):
        self.tokens, self.ends, self.vocab = tokens, np.cumsum(lens), vocab
        self.before = np.empty_like(tokens)
        self.before[1:] = tokens[:-1]
        self.before[self.ends[:-1]] = BEGIN
        if len(tokens):
            self.before[0] = BEGIN
        pair = self.before.astype(np.int64) << 32 | tokens
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        h = mix64(vocab[self.pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + vocab[self.pairs & 0xFFFFFFFF])
        home = bucket_of(h, buckets)
        place = home << np.uint64(48) | h & _LOW48
        self.order1, self.order2 = np.argsort(vocab, kind="stable"), np.argsort(place, kind="stable")
        self.keys1, self.keys2 = vocab[self.order1], (place & _LOW48)[self.order2]
        every = np.arange(buckets + 1, dtype=np.uint64)
        self.cuts1 = np.searchsorted(bucket_of(self.keys1, buckets), every)
        self.cuts2 = np.searchsorted(home[self.order2], every)


def chunk_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of CHUNK from (id, text, train): ``chunk`` rows with the tokens, ``ask`` rows with a bucket's keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        number_of: dict[bytes, int] = {}
        ids, lens, train, tokens = [], [], [], []

        def flush() -> pd.DataFrame:
            nonlocal number
            name = f"{task}-{number}"
            vocab = np.array([_END_HASH, _BEGIN_HASH, *[xxhash.xxh64_intdigest(w) for w in number_of]], np.uint64)
            tok, size, learn = np.array(tokens, np.int32), np.array(lens, np.int64), np.array(train, bool)
            c = Chunk(tok, size, vocab, buckets)
            from_train = np.repeat(learn, size)
            n1 = np.bincount(tok[from_train], minlength=len(vocab))
            n1[BEGIN] = learn.sum()
            n2 = np.bincount(c.pair_of[from_train], minlength=len(c.pairs))
            n1, n2 = n1[c.order1].astype(np.uint32), n2[c.order2].astype(np.uint32)
            rows = [("chunk", name, None, ids, lens, train, planes(tok), planes(vocab), None, None, None, None)]
            for b in range(buckets):
                s1, s2 = slice(*c.cuts1[b:b + 2]), slice(*c.cuts2[b:b + 2])
                rows.append(("ask", name, b, None, None, None, None, None, deltas(c.keys1[s1]), planes(n1[s1]),
                             deltas(c.keys2[s2]), planes(n2[s2])))
            number += 1
            return pd.DataFrame(rows, columns=CHUNK_NAMES)

        for b in batches:
            for i, text, learn in zip(b["id"], b["text"], b["train"]):
                words = text.encode("utf-8", "replace").lower().split() if text is not None else []
                tokens += [number_of.setdefault(w, len(number_of) + 2) for w in words]
                tokens.append(END)
                ids.append(None if pd.isna(i) else int(i))
                lens.append(len(words) + 1)
                train.append(bool(learn))
                if len(tokens) >= CHUNK_TOKENS:
                    yield flush()
                    number_of, ids, lens, train, tokens = {}, [], [], [], []
        if ids:
            yield flush()

    return docs.mapInPandas(run, CHUNK)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and the sum for every key given."""
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    return every, total, total[place]


ANSWER = ("kind string, chunk string, bucket int, ids array<long>, lens array<int>, train array<boolean>, tokens binary, "
          "vocab binary, counts1 binary, counts2 binary, n long, v long")
ANSWER_NAMES = [c.split()[0] for c in ANSWER.split(", ")]


def answers(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of ANSWER: ``chunk`` rows as they came, ``answer`` rows with the corpus counts in the order asked, and
    ``total`` rows with a bucket's share of N and V."""

    def add(g: pd.DataFrame) -> pd.DataFrame:
        asked, out = g[g["kind"] == "ask"], [g[g["kind"] == "chunk"].reindex(columns=ANSWER_NAMES)]
        if len(asked):
            k1, k2 = [undeltas(x) for x in asked["keys1"]], [undeltas(x) for x in asked["keys2"]]
            every, total, for1 = added(k1, [unplanes(x, np.uint32) for x in asked["counts1"]])
            _, _, for2 = added(k2, [unplanes(x, np.uint32) for x in asked["counts2"]])
            word = every != _BEGIN_HASH
            cut1, cut2 = np.cumsum([len(k) for k in k1])[:-1], np.cumsum([len(k) for k in k2])[:-1]
            out.append(pd.DataFrame({"kind": "answer", "chunk": asked["chunk"].to_numpy(), "bucket": asked["bucket"].to_numpy(),
                                     "counts1": [planes(x) for x in np.split(for1, cut1)],
                                     "counts2": [planes(x) for x in np.split(for2, cut2)]}).reindex(columns=ANSWER_NAMES))
            out.append(pd.DataFrame({"kind": ["total"], "n": [int(total[word].sum())], "v": [int((total[word] > 0).sum())]}).reindex(columns=ANSWER_NAMES))
        done = pd.concat(out, ignore_index=True)
        return done.astype({"bucket": "Int32", "n": "Int64", "v": "Int64"}).replace({float("nan"): None})

    home = F.coalesce("bucket", F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int"))
    return rows.groupBy(home).applyInPandas(add, ANSWER)


def with_counts(row, given: pd.DataFrame, buckets: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk and, per token, the corpus counts of its word, its context and both together."""
    lens = np.array(row["lens"], np.int64)
    c = Chunk(unplanes(row["tokens"], np.int32), lens, unplanes(row["vocab"], np.uint64), buckets)
    g = given.sort_values("bucket")
    c1, c2 = np.empty(len(c.vocab), np.int64), np.empty(len(c.pairs), np.int64)
    c1[c.order1] = np.concatenate([unplanes(x, np.int64) for x in g["counts1"]])
    c2[c.order2] = np.concatenate([unplanes(x, np.int64) for x in g["counts2"]])
    return c, c1[c.tokens], c1[c.before], c2[c.pair_of]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the count's binary logarithm."""
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXT_BUCKETS - 1)


def joined(chunks: DataFrame, given: DataFrame, run, kind: str) -> DataFrame:
    return chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(run, kind)


def held_out_histogram(chunks: DataFrame, given: DataFrame, n: int, buckets: int) -> list:
    """Counts of held-out tokens by context bucket and binary logarithm of the bigram's and unigram's estimates, in
    steps of 1/QUANTA (null for an estimate of 0)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            c, cw, cv, cvw = with_counts(row, right, buckets)
            learn = np.repeat(np.array(row["train"], bool), row["lens"])
            cw, cv, cvw = cw[learn] - 1, cv[learn] - 1, cvw[learn] - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.floor(np.log2(np.where(cvw > 0, cvw / cv, 0)) * QUANTA)
                q1 = np.floor(np.log2(np.where(cw > 0, cw / (n - 1), 0)) * QUANTA)
            h = pd.DataFrame({"b": context_bucket(cv).astype("int32"), "q2": q2, "q1": q1}).replace(-np.inf, 1)
            out.append(h.value_counts().rename("count").reset_index())
        return pd.concat(out) if out else pd.DataFrame(columns=["b", "q2", "q1", "count"])

    h = joined(chunks, given, run, "b int, q2 double, q1 double, count long")
    return h.groupBy("b", "q2", "q1").agg(F.sum("count").alias("count")).collect()


def learn_weights(histogram: list, v: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation."""
    weights = np.full((CONTEXT_BUCKETS, 3), np.nan)
    rows: dict[int, list] = {}
    for r in histogram:
        rows.setdefault(r["b"], []).append((r["q2"], r["q1"], r["count"]))
    for b, h in rows.items():
        a = np.array(h, float)
        middle = np.exp2((a[:, :2] + 0.5) / QUANTA)
        p = np.column_stack([np.where(a[:, :2] > 0, 0, middle), np.full(len(a), 1 / (v + 1))])
        p = np.minimum(p, 1)
        w = np.array([0.0 if b == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * a[:, 2:]).sum(axis=0) / a[:, 2].sum()
        w = np.maximum(w, [0, 0, 1e-9])                     # the uniform part keeps unknown words possible
        weights[b] = w / w.sum()
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in np.flatnonzero(np.isnan(weights[:, 0])):       # a bucket without training tokens takes its neighbour's
        weights[b] = weights[known[np.abs(known - b).argmin()]] if len(known) else [0, 0, 1]
    if len(known):
        weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def scores(chunks: DataFrame, given: DataFrame, n: int, v: int, weights: np.ndarray, buckets: int) -> DataFrame:
    """(id, train, n_tokens, n_known, base_score, score) of every document."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            c, cw, cv, cvw = with_counts(row, right, buckets)
            w = weights[context_bucket(cv)]
            p = w[:, 0] * cvw / np.maximum(cv, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1)
            base = np.log10((cw + 1) / (n + v + 1))
            sums = [np.add.reduceat(x, np.concatenate([[0], c.ends[:-1]])) for x in (base, np.log10(p))]
            out.append(pd.DataFrame({"id": pd.array(row["ids"], "Int64"), "train": np.array(row["train"], bool),
                                     "n_tokens": np.array(row["lens"], np.int64), "n_known": segment_sums(cw > 0, c.ends),
                                     "base_score": sums[0], "score": sums[1]}))
        return pd.concat(out)

    return joined(chunks, given, run, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train: str = "train") -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``train`` names a boolean column: the documents to learn from. ``score`` is
    the log10 probability of the whole text, ``base_score`` that of the
    add-one unigram model.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"),
                    F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("train"))
    chars = d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = int(min(MAX_BUCKETS, max(4, -(-chars // BUCKET_CHARS))))
    kinds = ["chunk", "answer", "total"]
    chunks, given, total = store_split(answers(chunk_rows(d, buckets), buckets), "counts", "kind", kinds)
    release(spark)
    n, v = total.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    given = given.select("chunk", "bucket", "counts1", "counts2")
    chunks = chunks.select("chunk", "ids", "lens", "train", "tokens", "vocab")
    weights = np.tile([0.0, 0.0, 1.0], (CONTEXT_BUCKETS, 1))
    if n:
        weights = learn_weights(held_out_histogram(chunks, given, n, buckets), v)
        release(spark)
    done = scores(chunks, given, n, v, weights, buckets)
    return done.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    held_out = F.coalesce(fold == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return lm_scores(docs).withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
