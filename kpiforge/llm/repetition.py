"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over the words of a text find the
n-grams that the text holds twice or more; the rules bound the share of the
text's characters that lie inside them, and inside repeated lines.

A document is judged by its own text alone: nothing is shuffled. Results for
special input: a null, empty or blank text has no words (all counts 0) and
fails the minimum word count; a repeated row gets the same result each time;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import blocks, fresh, mix64, segment_sums, table, trimmed

#: Largest share of word characters inside n-grams that occur twice or more, by n: from the
#: base rule's share at five words down to half of it at ten, as long repeats are seldom chance.
MAX_NGRAM_COVERAGE = {5: 0.20, 6: 0.18, 7: 0.16, 8: 0.14, 9: 0.12, 10: 0.10}
#: Largest share of a text's characters inside lines that repeat an earlier line.
MAX_LINE_COVERAGE = 0.20
MIN_WORDS = 10
#: Base rule: words in repeated windows of BASE_N words, in per cent of all words.
BASE_N, MAX_REPEAT_PERCENT = 5, 20

_BASE = np.uint64(0x9FB21C651E98DF25)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IN_WORD = np.ones(256, bool)                 # a byte that starts a code point of a word
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_IN_WORD[0x80:0xC0] = False

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "line_coverage double, ngram_coverage array<double>")


def repeated_windows(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    flags = np.zeros(len(keys), bool)
    if len(twice):
        near = np.zeros(1 << 16, bool)        # cheap test that clears most keys
        near[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(near[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(twice, keys[at])
        flags[at] = twice[np.minimum(place, len(twice) - 1)] == keys[at]
    return flags


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters."""
    seen: set[str] = set()
    count = chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if line in seen:
                count += 1
                chars += len(line)
            else:
                seen.add(line)
    return count, chars


def measure(texts: list[str], lengths: list[int]) -> dict[str, object]:
    """Counts and coverages of a block of texts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    byte_ends = np.cumsum([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids_of: dict[bytes, int] = {}
    ids: list[int] = []
    ends = np.empty(len(raw), np.int64)
    for i, b in enumerate(raw):
        ids += [ids_of.setdefault(w, len(ids_of)) for w in b.split()]
        ends[i] = len(ids)
    word = np.array(ids, np.int64)
    n_words = np.diff(ends, prepend=0)
    chars = np.array([len(w.decode("utf-8", "replace")) for w in ids_of], np.int64)[word] if len(word) else word
    owner = np.repeat(np.arange(len(raw)), n_words)
    left = ends[owner] - np.arange(len(word))              # words to the end of the text
    code = mix64(word)
    salt = mix64(owner + (1 << 32))
    word_chars = segment_sums(_IN_WORD[data], byte_ends)
    dup = [repeated_lines(t) for t in texts]
    out: dict[str, object] = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": segment_sums(_SYMBOL[data], byte_ends),
        "n_dup_lines": [d[0] for d in dup], "line_coverage": [d[1] / max(1, len(t)) for d, t in zip(dup, texts)]}
    rolling, coverage = code.copy(), []
    for n in range(2, max([BASE_N, *lengths]) + 1):
        if len(rolling) > 1:
            rolling = rolling[:-1] * _BASE + code[n - 1:]
        else:
            rolling = rolling[:0]
        if n != BASE_N and n not in lengths:
            continue
        at = np.flatnonzero(left[:len(rolling)] >= n)      # windows inside one text
        start = np.zeros(len(word) + 1, np.int64)
        start[at[repeated_windows(rolling[at] ^ salt[at])]] = 1
        begun = np.cumsum(start[:-1])
        begun[n:] -= begun[:-n].copy()                      # windows that cover the word
        covered = begun > 0
        if n == BASE_N:
            out["n_repeat_words"] = segment_sums(covered, ends)
        if n in lengths:
            coverage.append(segment_sums(chars * covered, ends) / np.maximum(1, word_chars))
    out["ngram_coverage"] = list(np.array(coverage).T.reshape(len(raw), len(lengths)))
    return out


def repetition_measures(text: Column, lengths: list[int] | None = None) -> Column:
    """Struct column of RESULT for a text column."""
    lengths = sorted(lengths or MAX_NGRAM_COVERAGE)

    @pandas_udf(RESULT)
    @trimmed
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.fillna("").tolist()
            parts = [pd.DataFrame(measure(texts[a:b], lengths)) for a, b in blocks(texts)]
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    return run(text)


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality",
                  max_ngram_coverage: dict[int, float] | None = None, max_line_coverage: float = MAX_LINE_COVERAGE,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """Add a struct column ``out``: the measures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than 20 % of them in
    repeated five-word windows. ``kept``: neither that nor any coverage above
    its limit.
    """
    limits = dict(sorted((max_ngram_coverage or MAX_NGRAM_COVERAGE).items()))
    q = docs.withColumn(out, repetition_measures(F.col(f"`{text}`"), list(limits)))
    m = F.col(f"`{out}`")
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    over = m["line_coverage"] > max_line_coverage
    for i, limit in enumerate(limits.values()):
        over = over | (m["ngram_coverage"][i] > limit)
    return q.withColumn(out, m.withField("base_failed", base).withField("kept", ~base & ~over))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    (out,) = fresh(docs, "quality")
    return quality_rules(docs, out=out).filter(F.col(out)["kept"]).drop(out)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names],
                    F.col("q.line_coverage").alias("line_coverage"),
                    F.array_max("q.ngram_coverage").alias("ngram_coverage"))
