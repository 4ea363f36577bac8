"""Language identification.

Sparse multinomial logistic regression on TF-IDF of character n-grams hashed to
``BUCKETS`` features, trained by follow-the-regularised-leader with elastic-net
penalties, then calibrated by one temperature.

Document frequencies come from all training rows. The regression and the
temperature are fitted on a bounded sample: ``per_lang`` rows per language and
``SAMPLE_ROWS`` rows in all in expectation, chosen by a hash of the id. Prediction reads every whole text; a
text's term frequencies are shares of its n-grams, so a logit is the mean over
positions of one table, looked up in numpy without a vector per document and in
slices of bounded size, so a very long text needs memory for its code points only.

Special input: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language are not learned from; without training rows all texts
are ``und``; repeated rows are predicted alike; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import blocks, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
PER_LANG = 400          # rows per language for the fit (documented bound)
SAMPLE_ROWS = 20_000    # rows for the fit in all (documented bound); above 50 languages each has fewer than PER_LANG
MAX_LANGS = 1000        # the model's table has a column for each
SLICE_VALUES = 1 << 20  # table values looked up at a time
CALIBRATION = 5         # one of so many sampled rows is kept for the temperature
BLOCK_BYTES = 1 << 20
UNDEFINED = "und"


@dataclass
class Settings:
    """Follow-the-regularised-leader: step ``alpha``/``beta``, penalties ``l1`` and ``l2``."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 4
    scale: float = 60.0
    per_lang: int = PER_LANG


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray = field(repr=False)     # BUCKETS x languages: idf * weight * scale
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0


def ngram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for every order."""
    h, out = codes.astype(np.uint32) + np.uint32(1), []
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1:].astype(np.uint32) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append((h * np.uint32(0x85EBCA6B) + np.uint32(n) >> np.uint32(17)).astype(np.int32))
    return out


def codes_of(text: str) -> np.ndarray:
    """Lower-cased code points, with a space at both ends."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts_of(text: str) -> np.ndarray:
    """Counts of a text's n-grams by bucket."""
    return np.bincount(np.concatenate(ngram_buckets(codes_of(text))), minlength=BUCKETS)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents) over a one-column frame; at most BUCKETS + 1 rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                seen[np.concatenate([np.unique(x) for x in ngram_buckets(codes_of(t))])] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": [-1, *at], "df": [n, *seen[at]]})

    rows = texts.mapInPandas(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS)
    for r in rows:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["df"]
    return df, sum(r["df"] for r in rows if r["bucket"] < 0)


def training_rows(train: DataFrame, id_col: str, lang: str, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of the id."""
    counts = train.groupBy(F.col(lang).alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return train.limit(0)
    per_lang = min(per_lang, max(1, SAMPLE_ROWS // len(counts)))
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_lang / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return train.filter(draw < shares[F.col(lang)])


def sampled_features(train: DataFrame, id_col: str, text: str, lang: str, per_lang: int) -> list[tuple]:
    """[(language, buckets, shares)] of the sample."""

    @pandas_udf("buckets array<int>, counts array<int>")
    def sparse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                c = counts_of(t)
                at = np.flatnonzero(c)
                rows.append((at.astype(np.int32), c[at].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["buckets", "counts"])

    rows = training_rows(train, id_col, lang, per_lang).select(
        F.col(lang).alias("lang"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("o"), sparse(F.col(text)).alias("x")).collect()
    rows.sort(key=lambda r: (r["o"] is None, r["o"], r["lang"], len(r["x"]["buckets"])))
    out = []
    for r in rows:
        c = np.array(r["x"]["counts"], float)
        out.append((r["lang"], np.array(r["x"]["buckets"]), c / c.sum()))
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple], langs: list[str], idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights BUCKETS x languages, bias) by per-coordinate follow-the-regularised-leader."""
    k, last = len(langs), BUCKETS                     # the last feature is the bias
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at, l1):
        w = -(z[at] - np.sign(z[at]) * l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) > l1, w, 0.0)

    where = {c: i for i, c in enumerate(langs)}
    for _ in range(s.epochs):
        for lang, buckets, share in rows:
            at, x = np.append(buckets, last), np.append(share * idf[buckets] * s.scale, 1.0)
            l1 = np.where(at == last, 0.0, s.l1)[:, None]
            w = weights(at, l1)
            error = softmax(x @ w)
            error[where[lang]] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    everything = np.arange(BUCKETS + 1)
    w = weights(everything, np.where(everything == last, 0.0, s.l1)[:, None])
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature of least log loss, by golden section on its logarithm."""
    def loss(u: float) -> float:
        p = softmax(logits / np.exp(u))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        settings: Settings | None = None) -> Model:
    """Fit on the rows of ``train`` that have a text with a letter and a language."""
    s = settings or Settings()
    train = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    df, n_docs = document_frequencies(train.select(F.col(text).alias("text")))
    rows = sampled_features(train, id_col, text, lang, s.per_lang)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    held = [r for i, r in enumerate(rows) if i % CALIBRATION == CALIBRATION - 1]
    weights, bias = fit_ftrl([r for i, r in enumerate(rows) if i % CALIBRATION != CALIBRATION - 1], langs, idf, s)
    lookup = (weights * idf[:, None] * s.scale)
    temperature = 1.0
    if held:
        logits = np.array([share @ lookup[b] for _, b, share in held]) + bias
        temperature = fit_temperature(logits, np.array([langs.index(r[0]) for r in held]))
    return Model(langs, lookup.astype(np.float32), bias, temperature)


def predict_block(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; all have a letter. Positions are looked up
    slice by slice, so memory beyond the texts' code points does not grow with
    their length or with the number of languages."""
    codes = [codes_of(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    starts = np.concatenate([[0], ends[:-1]])
    codes = np.concatenate(codes)
    logits = np.zeros((len(texts), len(model.langs)))
    step = max(1, SLICE_VALUES // len(model.langs))
    for a in range(0, len(codes), step):
        b = min(a + step, len(codes))
        first, last = np.searchsorted(ends, [a, b - 1], "right")        # texts that the slice meets
        at = slice(first, last + 1)
        for n, h in zip(ORDERS, ngram_buckets(codes[a:b + max(ORDERS) - 1])):
            h = h[:b - a]                                               # n-grams that begin in the slice
            total = np.zeros((len(h) + 1, len(model.langs)))
            np.cumsum(model.table[h], axis=0, out=total[1:])
            lo = np.minimum(np.maximum(starts[at], a) - a, len(h))
            hi = np.minimum(np.maximum(ends[at] - n + 1, a) - a, len(h))   # inside their text
            logits[at] += total[np.maximum(lo, hi)] - total[lo]
    sizes = ends - starts
    grams = sum(np.maximum(0, sizes - n + 1) for n in ORDERS)
    p = softmax((logits / grams[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    return [model.langs[i] for i in best], p[np.arange(len(texts)), best]


def predict(text: Column, model: Model) -> Column:
    """Struct column (lang, score) for a text column."""

    @pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = pd.DataFrame({"lang": [UNDEFINED] * len(s), "score": 0.0})
            at = [i for i, t in enumerate(s) if has_letter(t)] if model.langs else []
            texts = [s.iloc[i] for i in at]
            for a, b in blocks(texts, BLOCK_BYTES):
                lang, score = predict_block(texts[a:b], model)
                out.loc[at[a:b], "lang"] = lang
                out.loc[at[a:b], "score"] = score
            yield out

    return run(text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = docs.select("doc_id", "text", "lang", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    done = docs.select("doc_id", "held_out", predict(F.col("text"), model).alias("p"))
    return done.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
