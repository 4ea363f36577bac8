"""Exact substring dedup with suffix arrays.

Removes each byte that lies in a ``LENGTH``-byte string which also starts
earlier (smaller id, or same document and earlier start); strings are judged
on the input, overlaps count, and no string crosses documents.

1. Anchors. Of the ``GRAM``-byte substrings of every ``LENGTH``-byte window the
   one with the least hash (the leftmost of equals) is its anchor. Equal windows
   have equal anchors at the same place, so all that can repeat lies around
   anchors that occur twice. An anchor's context is the union of its windows.
2. A shuffle by anchor finds equal contexts (64-bit anchor and 64-bit context
   hash): all but the first are repeats as a whole. An anchor with several
   different contexts needs their suffixes compared.
3. Shards of such contexts get a suffix array by Larsson-Sadakane refinement in
   numpy (only unsorted groups are sorted again, with doubled prefixes) and
   Kasai common prefixes, run over all contexts at once. Neighbours in the array
   that share ``LENGTH`` bytes are equal windows; all but the first repeat.
4. A shard holds whole anchors, unless one has more than ``SPLIT`` contexts:
   that one is dealt over shards, each shard sends the first of each of its
   windows, and these sorted runs are merged across shards: every window's
   place is found by binary search in the bounds of Spark's range partitioning,
   and equal neighbours meet there.

Special input: null and empty texts, and texts shorter than ``LENGTH`` bytes,
stay whole; rows with a null id are neither compared nor cut; rows that repeat
id and text are one document (their bytes are not repeats of each other); rows
that share an id but not the text lose what any of them loses; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import mix64, store, store_split, table

LENGTH = 100
GRAM = 32
#: Bytes of a text that are hashed at a time, and of contexts that make a shard.
SEGMENT, SHARD_BYTES = 1 << 20, 1 << 19
#: Contexts of one anchor above which it is dealt over several shards.
SPLIT = 12_000
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte substring."""
    power = np.full(len(data) + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    back = np.full(len(data) + 1, _INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix64((total[GRAM:] - total[:-GRAM]) * back[:len(data) - GRAM + 1])


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of a text's anchors: each window has one anchor, and ``start`` to ``end`` is the union of
    the windows of an anchor."""
    found = []
    places = np.uint64(SEGMENT * 2 - 1)
    for a in range(0, max(1, len(text) - length + 1), SEGMENT):
        part = np.frombuffer(text, np.uint8)[a:a + SEGMENT + length - 1]    # windows that start in this segment
        if len(part) < length:
            continue
        h = gram_hashes(part)
        # of equal hashes (but for the low bits, which hold the place) the leftmost is the least
        least = sliding_least(h & ~places | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        place = (least & places).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        found.append((h[place[first]], first + a, last + a + length))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, id, span): anchor hash, context hash, and the context as start << 8 | bytes, of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["h", "c", "id", "span"]
        for b in batches:
            hs, cs, ids, spans, size = [], [], [], [], 0
            for i, text in zip(b["id"], b["text"]):
                raw = text.encode("utf-8", "replace")
                if len(raw) < length:
                    continue
                h, start, end = anchors(raw, length)
                hs.append(h)
                cs.append(np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist())], np.uint64))
                ids.append(np.full(len(h), i, np.int64))
                spans.append(start << 8 | end - start)
                size += len(h)
                if size > 200_000:
                    yield pd.DataFrame(dict(zip(names, [np.concatenate(hs).view(np.int64), np.concatenate(cs).view(np.int64), np.concatenate(ids), np.concatenate(spans)])))
                    hs, cs, ids, spans, size = [], [], [], [], 0
            if size:
                yield pd.DataFrame(dict(zip(names, [np.concatenate(hs).view(np.int64), np.concatenate(cs).view(np.int64), np.concatenate(ids), np.concatenate(spans)])))

    return docs.mapInPandas(run, "h long, c long, id long, span long")


def sorted_out(contexts: DataFrame) -> DataFrame:
    """Rows (kind, h, id, span): ``repeat`` for a context that occurred before, ``compare`` for the first of each
    different context of an anchor that has several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                                     # the last first-of-its-context, and whether it was sent
        sent = False
        for b in batches:
            carried = held is not None
            if carried:
                b = pd.concat([held, b], ignore_index=True)
            h, c, i, s = (b[x].to_numpy() for x in ("h", "c", "id", "span"))
            fresh = np.ones(len(b), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(fresh)
            first = at[np.cumsum(fresh) - 1]            # the first row with the same context
            again = ~fresh & ((i != i[first]) | (s != s[first]))
            same = h[at][1:] == h[at][:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            known = bool(several[-1]) or (len(at) == 1 and sent)
            if carried and sent:
                several[0] = False
            send = at[several]
            if again.any() or len(send):
                kind = np.concatenate([np.full(int(again.sum()), "repeat"), np.full(len(send), "compare")])
                rows = np.concatenate([np.flatnonzero(again), send])
                yield pd.DataFrame({"kind": kind, "h": h[rows], "id": i[rows], "span": s[rows]})
            held, sent = b.iloc[at[-1:]], known

    rows = contexts.repartition("h").sortWithinPartitions("h", "c", "id", "span")
    return rows.mapInPandas(run, "kind string, h long, id long, span long")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order, by Larsson-Sadakane refinement: groups that tie on ``done`` bytes are sorted by
    the ranks of what follows these bytes (two ranks where they fit in a key, so prefixes grow threefold).

    It goes on until no two suffixes tie: ``common_prefixes`` relies on the full order.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(8) | padded[k:k + n].astype(np.uint64)
    key = key << np.uint64(8) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)     # the end is less than any byte
    order = np.argsort(key)
    s = key[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    del key, s
    group_start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = group_start[np.cumsum(new) - 1]       # a group's number is where it starts
    done, bits = 7, n.bit_length()
    ranks = 2 if 3 * (bits + 1) <= 63 else 1            # following ranks that fit in one key

    def rank_at(place: np.ndarray) -> np.ndarray:
        """Rank + 1 of the suffixes at these places; past the end of the text it is 0."""
        return np.where(place < n, rank[np.minimum(place, n - 1)] + 1, 0)

    while True:
        unsorted = ~(new & np.append(new[1:], True))    # members of groups of two or more
        at = np.flatnonzero(unsorted)
        if not len(at):
            return order
        member = order[at]
        key = rank[member]
        for k in range(1, ranks + 1):
            key = key << np.int64(bits + 1) | rank_at(member + k * done)
        again = np.argsort(key)
        member, key = member[again], key[again]
        order[at] = member
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[at] = split
        rank[member] = at[np.flatnonzero(split)][np.cumsum(split) - 1]
        done *= ranks + 1


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: bytes that each suffix shares with the one before it in ``order``, up to ``limit``.

    A suffix shares at least one byte less than the suffix one place earlier in
    the text does. All contexts (at ``starts``) are walked at the same time.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(limit + 1, np.uint8)])
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out, shared = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    for step in range(int(sizes.max())):
        live = live[sizes[live] > step]
        at = starts[live] + step
        other = before[at]
        h = np.where(other >= 0, shared[live], 0)
        grow = np.flatnonzero((other >= 0) & (h < limit))
        while len(grow):
            x, y = at[grow] + h[grow], other[grow] + h[grow]
            grow = grow[(padded[x] == padded[y]) & (x < n) & (y < n)]
            h[grow] += 1
            grow = grow[h[grow] < limit]
        out[at] = h
        shared[live] = np.maximum(h - 1, 0)
    return out


def repeats_in(ids: np.ndarray, starts: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Windows of a shard: (position in the shard, context, id, start, class, is first of its class)."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(data)
    shared = common_prefixes(data, order, base, sizes, length)
    kind = np.empty(len(data), np.int64)
    kind[order] = np.cumsum(shared[order] < length)     # equal windows are neighbours in the array
    context = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(data)) - base[context]
    at = np.flatnonzero(offset + length <= sizes[context])
    context = context[at]
    doc, start, kind = ids[context], starts[context] + offset[at], kind[at]
    # in the order of the array, the least (document, start) of every class
    number = np.unique(ids, return_inverse=True)[1]
    name = number[context] << np.int64(32) | start
    window = np.full(len(data), -1, np.int64)
    window[at] = np.arange(len(at))
    by = window[order]
    by = by[by >= 0]
    lead = np.flatnonzero(np.diff(kind[by], prepend=-1))
    least = np.minimum.reduceat(name[by], lead) if len(by) else name
    first = np.empty(len(by), bool)
    first[by] = name[by] == np.repeat(least, np.diff(np.append(lead, len(by))))
    return at, context, doc, start, kind, first


def covered(context: np.ndarray, doc: np.ndarray, start: np.ndarray, flag: np.ndarray, length: int) -> pd.DataFrame:
    """Byte ranges (id, lo, hi) of flagged windows; consecutive ones of a context are one range."""
    at = np.flatnonzero(flag)
    if not len(at):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64)})
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(context[at]) != 0)
    lo = at[new]
    hi = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    return pd.DataFrame({"id": doc[lo], "lo": start[lo], "hi": start[hi] + length})


def shard_ranges(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(kind, id, lo, hi, window): ``range`` rows of repeated bytes, and ``first`` rows, the windows that shards of
    dealt anchors hold first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            at, context, doc, start, kind, first = repeats_in(rows["id"].to_numpy(), rows["start"].to_numpy(), list(rows["bytes"]), length)
            out = covered(context, doc, start, ~first, length).assign(kind="range", window=None)
            dealt = rows["dealt"].to_numpy()[context] & first
            if dealt.any():
                data, w = b"".join(rows["bytes"]), np.flatnonzero(dealt)
                out = pd.concat([out, pd.DataFrame({"kind": "first", "id": doc[w], "lo": start[w], "hi": start[w] + length,
                                                    "window": [data[p:p + length] for p in at[w].tolist()]})])
            return out[["kind", "id", "lo", "hi", "window"]]

        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            b = b.reset_index(drop=True)
            last = b[["h", "salt"]].ne(b[["h", "salt"]].shift(-1)).any(axis=1).to_numpy()   # an anchor's last row
            if held and len(b) and tuple(held[-1].iloc[-1][["h", "salt"]]) != tuple(b.iloc[0][["h", "salt"]]) and size >= shard_bytes:
                yield solve(pd.concat(held, ignore_index=True))
                held, size = [], 0
            begin, total = 0, size + b["bytes"].str.len().cumsum().to_numpy()
            while True:
                full = np.flatnonzero(last[begin:-1] & (total[begin:-1] >= shard_bytes))
                if not len(full):
                    break
                end = begin + int(full[0]) + 1
                yield solve(pd.concat([*held, b.iloc[begin:end]], ignore_index=True))
                total -= total[end - 1]
                held, begin = [], end
            held.append(b.iloc[begin:])
            size = int(total[-1])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    rows = contexts.repartition("h", "salt").sortWithinPartitions("h", "salt")
    return rows.mapInPandas(run, "kind string, id long, lo long, hi long, window binary")


def merged_across(firsts: DataFrame) -> DataFrame:
    """(id, lo, hi) of the windows that another shard holds earlier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = first = None
        for b in batches:
            keep = []
            for k, (i, lo, w) in enumerate(zip(b["id"], b["lo"], b["window"])):
                if w != window:
                    window, first = w, (i, lo)
                elif (i, lo) != first:
                    keep.append(k)
            yield b.iloc[keep][["id", "lo", "hi"]]

    return firsts.repartitionByRange("window").sortWithinPartitions("window", "id", "lo").mapInPandas(run, "id long, lo long, hi long")


def compared_contexts(docs: DataFrame, spans: DataFrame, split: int) -> DataFrame:
    """(h, salt, dealt, id, start, bytes) of the contexts to compare."""
    count = spans.groupBy("h").count().filter(F.col("count") > split)
    s = spans.join(count, "h", "left").withColumn("shards", F.ceil(F.coalesce(F.col("count") / split, F.lit(1))))
    s = s.select("h", "id", "span", F.pmod(F.xxhash64("id", "span"), F.col("shards")).alias("salt"), (F.col("shards") > 1).alias("dealt"))
    by_doc = s.groupBy("id").agg(F.collect_list(F.struct("h", "salt", "dealt", "span")).alias("x")).select(
        "id", *[F.col(f"x.{c}").alias(c) for c in ("h", "salt", "dealt", "span")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, *columns in zip(b["id"], b["text"], b["h"], b["salt"], b["dealt"], b["span"]):
                raw = text.encode("utf-8", "replace")
                for h, salt, dealt, span in zip(*[c.tolist() for c in columns]):
                    start = span >> 8
                    rows.append((h, salt, dealt, i, start, raw[start:start + (span & 255)]))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["h", "salt", "dealt", "id", "start", "bytes"])
                    rows = []
            yield pd.DataFrame(rows, columns=["h", "salt", "dealt", "id", "start", "bytes"])

    return docs.join(by_doc, "id").mapInPandas(run, "h long, salt long, dealt boolean, id long, start long, bytes binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, split: int = SPLIT) -> DataFrame:
    """(id, lo, hi): byte ranges of (id, text) documents to remove; they overlap."""
    repeat, compare = store_split(sorted_out(context_rows(docs, length)), "contexts", "kind", ["repeat", "compare"])
    whole = repeat.select("id", F.shiftright("span", 8).alias("lo"), (F.shiftright("span", 8) + F.col("span").bitwiseAND(F.lit(255))).alias("hi"))
    ranges, firsts = store_split(shard_ranges(compared_contexts(docs, compare, split), length, shard_bytes), "ranges", "kind", ["range", "first"])
    across = merged_across(firsts.select("id", "lo", "hi", "window"))
    return whole.unionByName(ranges.select("id", "lo", "hi")).unionByName(across)


def without_ranges(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, and maximal removed runs."""
    mark = np.zeros(len(raw) + 1, np.int64)
    np.add.at(mark, np.minimum(lo, len(raw)), 1)
    np.add.at(mark, np.minimum(hi, len(raw)), -1)
    gone = np.cumsum(mark[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                    shard_bytes: int = SHARD_BYTES, split: int = SPLIT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): every document without its repeated bytes (``kept`` is binary)."""
    if not GRAM < length <= 140:
        raise ValueError("length must be above 32 and at most 140 bytes")
    d = docs.select(F.col(f"`{id_col}`").alias("id0"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    ranges = repeated_ranges(d.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text"), length, shard_bytes, split)
    # a range is at most a few windows long: one number holds its start and length
    ranges = ranges.groupBy("id").agg(F.collect_set(F.shiftleft("lo", 16).bitwiseOR(F.col("hi") - F.col("lo"))).alias("ranges"))

    @pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for t, r in zip(texts, found):
                raw = (t or "").encode("utf-8", "replace")
                if r is None or not len(r):
                    rows.append((len(raw), 0, 0, raw))
                else:
                    kept, removed, spans = without_ranges(raw, r >> 16, (r >> 16) + (r & 0xFFFF))
                    rows.append((len(raw), removed, spans, kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    done = d.join(ranges, "id", "left").select("id0", cut("text", "ranges").alias("c"))
    return done.select(F.col("id0").alias(id_col), "c.*")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
