"""Best-fit packing with linear grouping.

Documents become token pieces of at most ``capacity`` tokens. The plan is made
on the histogram of piece lengths (at most ``capacity`` rows, whatever the
input's size): large lengths are rounded up within groups of equal cardinality,
fillings of a sequence are optimised over those few sizes, actual lengths take
the places of the rounded ones, and the small pieces go by best fit into the
tightest space. A plan is a list of runs
of equal sequences, so every piece finds its place from its length and its rank
among the pieces of that length; ranks come from salted groups.

Special input: a null or empty text is one piece that holds the end id alone;
repeated rows are packed as often as they occur; a null id is packed like any
other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import blocks, store, table

CAPACITY = 2048
END_ID = 0
#: Pieces from this share of the capacity on count as large.
LARGE_SHARE = 0.125
#: Most groups of large lengths; fewer when there are few pieces.
GROUPS = 1024
#: Rows of one length that one task ranks.
RANK_ROWS = 50_000
#: Words whose ids a worker keeps, in each of two generations.
CACHED_WORDS, PIPELINE_CACHED_WORDS = 400_000, 60_000
VOCABULARY = "word_bpe_49k.json"
#: Punctuation at the edges of a word that the tokenizer splits off.
_EDGES = b".,;:!?*$%&#|"


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases, and never joins what white
    space or a change between letters and punctuation separates, so that the
    ids of a word can be kept."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cached_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark, token = max(special.items())
        self.mark_text = token.content
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), self.mark + 1), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def ids_of(self, words: list[str], marked: bool) -> list[bytes]:
        """Ids of each word from one call for all: words end at end-of-word ids, or where special tokens stand."""
        text = (self.mark_text if marked else " ").join(words)
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        raw = ids.tobytes()
        cuts = np.flatnonzero(ids == self.mark) if marked else np.flatnonzero(self.ends[ids])
        if marked:
            starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)]
        elif len(cuts) == len(words):                       # every word ends once at least, so each ends once
            ends = (4 * (cuts + 1)).tolist()
            starts = [0, *ends[:-1]]
        else:
            return self.ids_of(words, True)
        return [raw[a:b] for a, b in zip(starts, ends)]

    def learn(self, words: list[bytes]) -> None:
        """Put the ids of new words in the young generation. A word of letters is tokenized without the punctuation
        around it, which the tokenizer splits off."""
        young, old = self.young, self.old
        letters: dict[bytes, str] = {}
        others: dict[bytes, str] = {}
        parts = []
        for w in words:
            bare = w.strip(_EDGES)
            text = bare.decode("utf-8", "replace")
            if not text.isalpha():
                others[w] = w.decode("utf-8", "replace")
                continue
            if bare not in young:
                if bare in old:
                    young[bare] = old[bare]
                else:
                    letters[bare] = text
            if bare != w:
                at = w.index(bare)
                edges = w[:at], w[at + len(bare):]
                parts.append((w, edges[0], bare, edges[1]))
                for e in edges:
                    if e and e not in young:
                        others[e] = e.decode()
        special = {w: t for w, t in others.items() if "<|" in t}
        for w, t in special.items():
            young[w] = self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
        for some, marked in ((letters, False), ({w: t for w, t in others.items() if w not in special}, True)):
            keys, texts = list(some), list(some.values())
            for i in range(0, len(keys), 500):
                young.update(zip(keys[i:i + 500], self.ids_of(texts[i:i + 500], marked)))
        young[b""] = b""
        for w, before, bare, after in parts:
            young[w] = young[before] + young[bare] + young[after]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for a, b in blocks(texts, 1 << 21):
            if len(self.young) > self.limit:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            fresh: set[bytes] = set()
            found = []                                      # per text: ids of its words, places and words without
            for t in texts[a:b]:
                # the tokenizer lower-cases; done first, it leaves fewer words to know (special strings keep their case)
                words = (t if b"<|" in t else t.lower()).split()
                ids = list(map(young.get, words))
                gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
                names = [words[i] for i in gaps]
                fresh.update(names)
                found.append((ids, gaps, names))
            known = old.keys() & fresh
            for w in known:
                young[w] = old[w]
            self.learn(list(fresh - known))
            for ids, gaps, names in found:
                for i, w in zip(gaps, names):
                    ids[i] = young[w]
                yield b"".join(ids)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str, cached_words: int = CACHED_WORDS) -> WordTokenizer:
    """One tokenizer, with its cache, per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path, cached_words)
    _TOKENIZERS[path].limit = cached_words
    return _TOKENIZERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 capacity: int = CAPACITY, keep_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``END_ID``, cut
    only where a document is longer than ``capacity``. ``vocabulary`` names an installed file or gives a path."""
    kind = "struct<piece int, start long, length long, ids_crc32 long" + (", ids array<int>>" if keep_ids else ">")

    @pandas_udf(f"array<{kind}>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer_at(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary), cached_words)
        tail, step = WordTokenizer.pack([END_ID]), 4 * capacity
        for s in batches:
            out = []
            for raw in tok.encode(s.tolist()):
                raw += tail
                rows = []
                for k, a in enumerate(range(0, len(raw), step)):
                    ids = raw[a:a + step]
                    row = {"piece": k, "start": a // 4, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids)}
                    rows.append(row | {"ids": np.frombuffer(ids, "<u4").astype("i4")} if keep_ids else row)
                out.append(rows)
            yield pd.Series(out, dtype=object)

    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`"), F.explode(cut(raw)).alias("p")).select(f"`{id_col}`", "p.*")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Fillings of a sequence and how often to use each: (times, sizes in it).

    ``sizes`` fall. The longest size left is fixed, and the sizes still in
    demand that leave the least space beside it are found exactly, by a bounded
    subset-sum table whose rows are bit sets; the filling is used until one of
    its sizes runs out, so there are about as many fillings as sizes.
    """
    left, found = list(demand), []
    for top in range(len(sizes)):
        while left[top]:
            left[top] -= 1
            room = capacity - sizes[top]
            table, used = [1], []
            for i in range(top, len(sizes)):
                if sizes[i] <= room and left[i]:
                    reach, shifted = table[-1], table[-1]
                    for _ in range(min(left[i], room // sizes[i])):
                        shifted = shifted << sizes[i] & ((2 << room) - 1)
                        reach |= shifted
                    table.append(reach)
                    used.append(i)
                    if reach >> room & 1:
                        break
            fill, chosen = table[-1].bit_length() - 1, [top]
            for k in range(len(used) - 1, -1, -1):          # the smaller size only where the larger ones don't do
                copies = 0
                while not table[k] >> fill & 1:
                    fill -= sizes[used[k]]
                    copies += 1
                    chosen.append(used[k])
            left[top] += 1
            times = min(left[i] // chosen.count(i) for i in set(chosen))
            for i in chosen:
                left[i] -= times
            found.append((times, [sizes[i] for i in chosen]))
    return found


class Run:
    """``count`` sequences with the same slots."""

    __slots__ = ("count", "slots", "space")

    def __init__(self, count: int, slots: tuple[int, ...], capacity: int):
        self.count, self.slots, self.space = count, slots, capacity - sum(slots)


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs that hold exactly the pieces of ``histogram`` (length -> count)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    runs = [Run(left.pop(capacity), (capacity,), capacity)] if capacity in left else []
    large = sorted((n for n in left if n >= capacity * LARGE_SHARE), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        share = -(-total // max(1, min(groups, total)))
        queues: list[list[list[int]]] = []                  # per group [length, count], longest first
        room = 0
        for n in large:
            count = left[n]
            while count:
                if not room:
                    queues.append([])
                    room = share
                take = min(room, count)
                queues[-1].append([n, take])
                room, count = room - take, count - take
        merged: dict[int, list[list[int]]] = {}             # groups with the same rounded length are one
        for q in queues:
            merged.setdefault(q[0][0], []).extend(q)
        sizes = sorted(merged, reverse=True)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        for times, slots in configurations(sizes, demand, capacity):
            while times:
                # actual pieces take the places: each slot draws from a copy of its group's queue
                wanted = {s: slots.count(s) for s in slots}
                n = min(times, *(max(1, merged[s][0][1] // w) for s, w in wanted.items()))
                actual = []
                for s, w in wanted.items():
                    need = n * w
                    if merged[s][0][1] >= need:
                        actual += [merged[s][0][0]] * w
                        merged[s][0][1] -= need
                    else:                                    # n is 1 here: draw piece by piece
                        for _ in range(w):
                            actual.append(merged[s][0][0])
                            merged[s][0][1] -= 1
                            if not merged[s][0][1]:
                                merged[s].pop(0)
                    if merged[s] and not merged[s][0][1]:
                        merged[s].pop(0)
                runs.append(Run(n, tuple(actual), capacity))
                times -= n
        for n in large:
            del left[n]
    return best_fit(runs, left, capacity)


def best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """Longest pieces first, each into the tightest space that holds it."""
    by_space: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for r in runs:
        by_space[r.space].append(r)
    for n in sorted(left, reverse=True):
        count = left[n]
        space = n
        while count:
            while space <= capacity and not by_space[space]:
                space += 1
            if space > capacity:
                by_space[capacity].append(Run(-(-count // (capacity // n)), (), capacity))
                space = capacity
            r = by_space[space].pop()
            each = space // n
            full = min(r.count, count // each)
            if full:
                done = Run(full, r.slots + (n,) * each, capacity)
                by_space[done.space].append(done)
            elif r.count:
                full = 1
                done = Run(1, r.slots + (n,) * count, capacity)
                by_space[done.space].append(done)
                each = count
            count -= full * each
            if r.count > full:
                by_space[space].append(Run(r.count - full, r.slots, capacity))
    return [r for rs in by_space for r in rs if r.slots]


def slot_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted (length, from_rank) -> first sequence, offset."""
    rows, used, base = [], {}, 0
    for r in runs:
        offset = 0
        for n in r.slots:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + r.count
            offset += n
        base += r.count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def ranked(pieces: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """Add ``_rank``: 0, 1, ... among the pieces of the same length. Lengths with many pieces are split by salt."""
    salts = max(1, -(-largest // RANK_ROWS))
    p = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    return p.withColumn("_inside", inside).join(starts, ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.col("_inside")).drop("_salt", "_inside", "_before")


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` column; ``keys`` name a piece."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}   # <= capacity rows
    slots = slot_table(plan_runs(histogram, capacity, groups))
    first = slots["length"] << np.int64(44) | slots["rank"]

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(first, length.to_numpy() << np.int64(44) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": slots["sequence"][at] + rank.to_numpy() - slots["rank"][at],
                             "offset": slots["offset"][at]})

    done = ranked(pieces, keys, max(histogram.values(), default=0)).withColumn("_place", place("length", "_rank"))
    return done.select(*[f"`{c}`" for c in pieces.columns], "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                   capacity: int = CAPACITY, keep_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Token pieces of all documents with their place; texts are tokenized once and kept in the shared folder."""
    pieces = store(token_pieces(docs, id_col, text, vocabulary, capacity, keep_ids, cached_words), "pieces")
    return pack(pieces, [id_col, "piece", "start"], capacity)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row per token piece with its sequence and offset. Workers live on after it, so they keep
    fewer words than in a run of its own."""
    return pack_documents(docs, cached_words=PIPELINE_CACHED_WORDS)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
