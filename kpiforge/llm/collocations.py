"""Phrase collocations by broadcast tries over the whole corpus.

1. Words are counted per language; those that occur ``MIN_COUNT`` times get
   numbers, and the corpus is stored once as blocks of numbers, 0 standing for
   every other word and for each border that no phrase crosses.
2. Level by level (2, 3, 4 words) the candidates are phrases whose first and
   last part of one word less are frequent (what Apriori allows) and whose
   counts, summed over blocks with each block's share cut at ``MIN_COUNT``,
   reach it: no frequent phrase is lost.
3. The candidates of a level form a double-array trie that is broadcast. numpy
   advances the states of all positions of a block at the same time, a word a
   step; a bincount of the accepting states gives the block's counts, which
   Spark sums over all blocks. The same pass lists the next level's candidates.
4. Scores, containment and ranks are joins and a window with a map-side limit.

Whatever is broadcast is bounded: at most ``MAX_WORDS`` words or ``MAX_PHRASES``
phrases at a time. Beyond that the corpus is passed over once for each further
share (words by hash, phrases by range); the results are the same.

Special input: null and empty texts hold no word; a null language counts as
``und``; rows that repeat count each time; a text of any length is a run of
blocks, cut only where no phrase can cross; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import UPPER, discard, store, table, trimmed

MIN_COUNT, LONGEST, BEST = 30, 4, 2000
#: A candidate inside a longer one with at least this share of its count (per cent) is dropped.
INSIDE = 80
#: Words and phrases that are broadcast at a time; numbers of a block.
MAX_WORDS, MAX_PHRASES, BLOCK = 1_000_000, 1_000_000, 1 << 19
#: Distinct words that a task counts before it sends them, and shares in which a language is ranked first.
COUNTED, RANK_SHARES = 250_000, 64
#: A word number is two digits of DIGIT bits in the trie.
DIGIT = 12
#: Words of more bytes are known by their digest in what is broadcast.
KEY_BYTES = 32

BORDERS = b".,;:!?\n\v\f\r"
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)) + BORDERS, bytes(range(97, 123)) + b"," * len(BORDERS))


def tokens(text: str) -> list[bytes]:
    """Words of a text, and a comma for each border."""
    return text.encode("utf-8", "replace").translate(_TO_LOWER).replace(b",", b" , ").split()


def word_key(word: bytes) -> bytes:
    """What stands for a word in the broadcast vocabulary: no word holds a space."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.sha256(word).digest()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) summed over the tasks; the null word holds the language's total."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(found: dict[str, Counter]) -> pd.DataFrame:
            out = [(lang, w.decode("utf-8"), c) for lang, f in found.items() for w, c in f.items() if w != b","]
            out += [(lang, None, f.total() - f[b","]) for lang, f in found.items()]
            return pd.DataFrame(out, columns=["lang", "word", "f"])

        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                found.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, found.values())) > COUNTED:
                    yield rows(found)
                    found = {}
        yield rows(found)

    partial = docs.mapInPandas(trimmed(run), "lang string, word string, f long")
    return partial.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """Add ``id``: 1, 2, ... over (lang, word), by counts of range partitions."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = words.repartitionByRange(parts, "lang", "word").sortWithinPartitions("lang", "word")
    ranged = store(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "vocabulary")
    runs = ranged.groupBy("part").agg(F.min("at").alias("least"), F.count("*").alias("size"))
    runs = runs.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = ranged.join(F.broadcast(runs), "part").withColumn("id", F.col("at") - F.col("least") + F.col("before") + 1)
    out = store(out.select("lang", "word", "f", "id"), "words")
    discard(ranged)
    return out


def with_numbers(docs: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """(ids): blocks of word numbers as little-endian 32-bit integers, 0 at borders and other words."""
    spark = docs.sparkSession
    shares = max(1, -(-count // MAX_WORDS))
    short = F.octet_length("word") <= KEY_BYTES
    key = F.when(short, F.encode("word", "UTF-8")).otherwise(F.concat(F.encode(F.lit(" "), "UTF-8"), F.unhex(F.sha2("word", 256))))
    keyed = words.select("lang", key.alias("key"), "id", F.pmod(F.xxhash64("word"), F.lit(shares)).alias("share"))

    def known(share: int):
        found: dict[str, dict[bytes, int]] = {}
        mine = keyed.filter(F.col("share") == share).select("lang", "key", "id").toArrow()
        for lang_, k, i in zip(*(c.to_pylist() for c in mine.columns)):
            found.setdefault(lang_, {})[k] = i
        digests = {lang_ for lang_, own in found.items() if any(len(k) > KEY_BYTES for k in own)}
        return spark.sparkContext.broadcast((found, digests))

    def look_up(vocabulary, lang: str, text: str) -> np.ndarray:
        found, digests = vocabulary.value
        get = found.get(lang, {}).get
        words_ = tokens(text)
        if lang in digests:
            words_ = map(word_key, words_)
        return np.array([get(t, 0) for t in words_], np.int32)

    if shares > 1:
        docs = store(docs.withColumn("ids", F.lit(b"")), "texts")
        for share in range(shares):
            vocabulary = known(share)

            def add(batches, vocabulary=vocabulary):
                for b in batches:
                    ids = []
                    for lang, text, had in zip(b["lang"], b["text"], b["ids"]):
                        new = look_up(vocabulary, lang, text)
                        ids.append((new + np.frombuffer(had, np.int32) if had else new).tobytes())
                    yield b.assign(ids=ids)

            more = store(docs.mapInPandas(add, docs.schema), "texts")
            discard(docs)
            docs = more
    else:
        vocabulary = known(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [np.zeros(1, np.int32)], 0
        for b in batches:
            for k, (lang, text) in enumerate(zip(b["lang"], b["text"])):
                ids = look_up(vocabulary, lang, text) if shares == 1 else np.frombuffer(b["ids"].iloc[k], np.int32)
                ids = np.append(ids, np.int32(0))
                ids = ids[(ids != 0) | (np.concatenate([[0], ids[:-1]]) != 0)]        # one 0 of a run is enough
                while size + len(ids) >= BLOCK:
                    gaps = np.flatnonzero(ids == 0)
                    cut = gaps[min(np.searchsorted(gaps, BLOCK - size), len(gaps) - 1)] + 1 if len(gaps) else 0
                    yield pd.DataFrame({"ids": [np.concatenate([*held, ids[:cut]]).tobytes()]})
                    held, size, ids = [np.zeros(1, np.int32)], 0, ids[cut:]
                held.append(ids)
                size += len(ids)
        if size:
            yield pd.DataFrame({"ids": [np.concatenate(held).tobytes()]})

    return store(docs.mapInPandas(trimmed(run), "ids binary"), "numbers")


class Trie:
    """Double-array trie of equally long phrases (rows of word numbers, sorted): child of s by digit c is base[s] + c where check is s."""

    def __init__(self, phrases: np.ndarray):
        digits = np.empty((len(phrases), 2 * phrases.shape[1]), np.int64)
        digits[:, 0::2], digits[:, 1::2] = phrases >> DIGIT, phrases & ((1 << DIGIT) - 1)
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -2, np.int64)
        state = np.zeros(len(phrases), np.int64)
        self.used, self.random = np.ones(1, bool), np.random.default_rng(7)
        for depth in range(digits.shape[1]):
            state = self._level(state, digits[:, depth])
        self.accept = state                                     # state of each phrase
        self.base, self.check = self.base.astype(np.int32), self.check.astype(np.int32)
        del self.used, self.random

    def _level(self, state: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Place all children of a depth; equal rows of (state, digit) are one child. Returns the children of all rows."""
        new = np.ones(len(state), bool)
        new[1:] = (state[1:] != state[:-1]) | (digit[1:] != digit[:-1])
        child = np.flatnonzero(new)
        parent, d = state[child], digit[child]
        first = np.flatnonzero(np.diff(parent, prepend=-1))     # rows are sorted, so a parent's children are a run
        size = np.diff(np.append(first, len(parent)))
        place = np.empty(len(parent), np.int64)
        self._grow(int(self.used.sum()) + 2 * len(parent) + (1 << DIGIT))
        for n in np.unique(size)[::-1].tolist():                # families of many children first, while there is room
            child_of = first[size == n][:, None] + np.arange(n)
            place[child_of] = self._free(d[child_of])
        self.base[parent] = place - d
        self.check[place] = parent
        return place[np.cumsum(new) - 1]

    def _free(self, run: np.ndarray) -> np.ndarray:
        """Places for families of children (rows of digits), tried at random for all of them together; taken at once."""
        offset = run - run[:, :1]
        place = np.empty_like(run)
        open_, tries = np.arange(len(run)), 0
        while len(open_):
            at = self.random.integers(0, len(self.used) - (1 << DIGIT), len(open_))[:, None] + offset[open_]
            self._grow(int(at.max()) + 1)
            row = np.arange(len(open_))
            fits = ~self.used[at].any(axis=1)
            if len(open_) > 64:
                claim = np.full(len(self.used), -1, np.int32)
                claim[at[fits][::-1].ravel()] = np.repeat(row[fits][::-1], run.shape[1])       # the first family wins
                fits[fits] = (claim[at[fits]] == row[fits][:, None]).all(axis=1)
            else:
                fits &= row == (fits.argmax() if fits.any() else -1)                          # one at a time
            place[open_[fits]] = at[fits]
            self.used[at[fits]] = True
            open_, tries = open_[~fits], 0 if fits.any() else tries + 1
            if tries > 30:
                self._grow(len(self.used) + len(self.used) // 4)
                tries = 0
        return place

    def _grow(self, size: int) -> None:
        if size > len(self.used):
            more = size - len(self.used)
            self.used = np.concatenate([self.used, np.zeros(more, bool)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def advance(self, ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, accepting states) of the phrases of ``words`` words that start in ``ids`` (which ends with a 0)."""
        at = np.flatnonzero(ids)
        state = np.zeros(len(at), np.int32)
        for step in range(words):
            near = at + step
            inside = near < len(ids)
            word = np.where(inside, ids[np.minimum(near, len(ids) - 1)], 0)
            for high in (True, False):
                to = self.base[state] + (word >> DIGIT if high else word & ((1 << DIGIT) - 1))
                ok = (to >= 0) & (to < len(self.check)) & (word > 0)
                ok[ok] = self.check[to[ok]] == state[ok]
                at, state, word = at[ok], to[ok], word[ok]
        return at, state


def summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.sum("c").alias("c")).filter((F.col("kind") == 0) | (F.col("c") >= least))


def block_rows(ids: np.ndarray, trie: Trie | None, words: int, apriori: bool, least: int) -> pd.DataFrame:
    """Counts of a block: (0, state, count) of the trie's phrases, and (1, state << 32 | word, count up to ``least``)
    of candidates of one word more."""
    if trie is None:                                            # the words themselves are the phrases
        at = np.flatnonzero(ids)
        state, parts = ids[at], []
    else:
        at, state = trie.advance(ids, words)
        count = np.bincount(state, minlength=1)
        seen = np.flatnonzero(count)
        parts = [(0, seen, count[seen])]
    if words < LONGEST:
        after = ids[np.minimum(at + words, len(ids) - 1)]
        ok = after > 0
        if apriori:
            alive = np.zeros(len(ids) + 1, bool)
            alive[at] = True
            ok &= alive[at + 1]
        key, n = np.unique(state[ok].astype(np.int64) << 32 | after[ok], return_counts=True)
        parts.append((1, key, np.minimum(n, least)))
    return pd.DataFrame({"kind": np.concatenate([np.full(len(k), t, np.int8) for t, k, _ in parts]),
                         "key": np.concatenate([k.astype(np.int64) for _, k, _ in parts]),
                         "c": np.concatenate([c.astype(np.int64) for _, _, c in parts])})


def passed_over(blocks: DataFrame, trie: Trie | None, words: int, apriori: bool, least: int) -> DataFrame:
    """(kind, key, c) of one pass over the numbered corpus."""
    sent = blocks.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["ids"]:
                yield block_rows(np.frombuffer(raw, np.int32), sent.value, words, apriori, least)

    return store(summed(blocks.mapInPandas(run, "kind byte, key long, c long"), least), "counts")


def frequent_phrases(blocks: DataFrame, least: int) -> list[DataFrame]:
    """For 2 to LONGEST words a table (ids, f): phrases that occur at least ``least`` times."""
    spark = blocks.sparkSession
    counts = passed_over(blocks, None, 1, False, least)
    listed = store(counts.select(F.array(F.shiftright("key", 32).cast("int"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("ids")), "candidates")
    discard(counts)
    found = []
    for words in range(2, LONGEST + 1):
        total = listed.count()
        shares = -(-total // MAX_PHRASES)
        exact, further = [], []
        if shares > 1:                                          # ranges of phrases, a pass for each
            cut = listed.repartitionByRange(shares, "ids").withColumn("share", F.spark_partition_id())
            cut = store(cut, "candidates")
        for share in range(shares):
            part = listed if shares == 1 else cut.filter(F.col("share") == share)
            spelt = [f"w{i}" for i in range(words)]
            arrow = part.select(*[F.col("ids")[i].alias(w) for i, w in enumerate(spelt)]).toArrow()
            phrases = np.stack([c.to_numpy() for c in arrow.columns], axis=1).astype(np.int64)
            if not len(phrases):
                continue
            phrases = phrases[np.lexsort(phrases.T[::-1])]
            trie = Trie(phrases)
            counts = passed_over(blocks, trie, words, shares == 1, least)
            columns = [trie.accept, *phrases.astype(np.int32).T]
            names = spark.createDataFrame(pa.table(dict(zip(["state", *spelt], map(pa.array, columns))))).select("state", F.array(*spelt).alias("ids"))
            exact.append(store(counts.filter("kind = 0").join(names, F.col("key") == F.col("state")).select("ids", F.col("c").alias("f")), "phrases"))
            if words < LONGEST:
                longer = counts.filter("kind = 1").join(names, F.shiftright("key", 32) == F.col("state")).select(
                    F.concat("ids", F.array(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("ids"))
                further.append(store(longer, "candidates"))
            discard(counts)
        empty = spark.createDataFrame([], "ids array<int>, f long")
        found.append(_all(exact, empty))
        listed = _all(further, empty.select("ids"))
    return found


def _all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(phrases: list[DataFrame], words: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of the candidates that no longer one covers."""
    every = words.select(F.array(F.col("id").cast("int")).alias("ids"), "f")
    candidates = _all(phrases, None)
    every = store(every.unionByName(candidates), "every")
    n = F.size("ids")
    cuts = candidates.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(every.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(
        every.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    wide = "decimal(20,0)"
    score = F.expr(f"(CAST(2000000 AS {wide}) * CAST(a AS {wide})) div (CAST(l AS {wide}) + CAST(r AS {wide}))")
    best = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("ids", i, m))))
    covers = candidates.filter(n > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = best.join(covers, "ids", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    return kept.select("ids", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``best`` phrases of each language."""
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = store(word_counts(given).filter(F.col("word").isNull() | (F.col("f") >= least)), "counted")
    totals = counted.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words = numbered(counted.filter(F.col("word").isNotNull()))
    blocks = with_numbers(given, words, words.count())
    phrases = frequent_phrases(blocks, least)
    kept = scored(phrases, words).withColumn("row", F.monotonically_increasing_id())
    kept = store(kept, "scored")
    spelt = kept.select("row", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id").groupBy("row").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    done = kept.join(spelt, "row")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES))                # so no task gets a whole language
    first = done.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The result of ``op13_phrase_collocations`` in DuckDB SQL (all word runs are listed, so for small tables).
ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS a FROM p),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(a) - k + 1), lambda i: a[i:i + k - 1])) AS g
      FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(a) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, g, f AS a, j, g[1:j] AS head, g[j + 1:k] AS tail FROM c, (VALUES (1), (2), (3)) v(j) WHERE j < k),
s AS (SELECT cut.lang, cut.g, a, j, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
      FROM cut JOIN f h ON h.lang = cut.lang AND h.g = head JOIN f t ON t.lang = cut.lang AND t.g = tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM s) WHERE nth = 1),
i AS (SELECT lang, f, g[x:x + m - 1] AS g FROM c, (VALUES (2), (3)) v(m), (VALUES (1), (2), (3)) u(x) WHERE m < k AND x + m - 1 <= k),
o AS (SELECT lang, g, max(f) AS longer FROM i GROUP BY lang, g),
x AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g
      WHERE longer IS NULL OR 100 * longer < 80 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
