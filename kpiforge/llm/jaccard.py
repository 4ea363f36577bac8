"""N-gram Jaccard join with rare-first prefix filtering.

A document is the set of its distinct five-word shingles (64-bit hashes of
lower-cased words). Two documents link when 100 * common >= 75 * union.

1. One pass counts shingles in a sketch of fixed size and gives each document
   its class: the documents with the same set.
2. Shingles are ordered rare first (sketch count, then hash: the same total
   order everywhere, whatever the sketch's error), and each class sends the
   shingles of its prefix, with their position. Classes that meet on a
   shingle are candidates if length and position allow enough overlap.
3. Candidates are verified once per pair: a suffix filter bounds the overlap
   by counts in ranges of the hash, then the sets (48 bits of each hash) are
   intersected.

Links are wanted for the classes they join. So hot shingles are first checked
against one class each (a star); after that only candidates that are still in
different components are paired, which loses no link between components.

Special input: a null, empty or blank text has no shingle and links with
nothing; a text of fewer than five words is one shingle; rows with a null id
are left out of the join; rows that repeat an id get a row each, by their own
text; other columns are ignored (the pipeline stage keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import UPPER, blocks, discard, fresh, mix64, release, store, table, trimmed
from kpiforge.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Counters of the frequency sketch, whatever the input's size. Tasks send one byte for each (255: at least 255), in parts.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Bits of the filter that picks the documents whose sets are wanted.
FILTER_BITS = 25
#: Classes whose prefixes a task remembers having sent.
SENT_CLASSES = 100_000
#: Open candidate rows, per row of their groups, up to which all open pairs are listed; above, another star round
#: comes first, up to so many.
OPEN_SHARE, STAR_ROUNDS = 200, 4
SUFFIX_RANGES = 32
#: Prefix rows that a task packs for the shuffle at a time, and the bytes of one of them.
LOT_ROWS, ROW_BYTES = 1 << 19, 18

_BASE = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    code_of: dict[bytes, int] = {}
    ids: list[int] = []
    ends = []
    for t in texts:
        ids += [code_of.setdefault(w, len(code_of)) for w in t.lower().split()]
        ends.append(len(ids))
    code = np.array([xxhash.xxh64_intdigest(w) for w in code_of], np.uint64)
    word = code[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    rolled = word[:max(0, len(word) - n + 1)]
    for k in range(1, n):
        rolled = rolled * _BASE + word[k:k + len(rolled)]
    rolled = mix64(rolled)
    out, a = [], 0
    for b in ends:
        if b - a >= n:
            s = np.sort(rolled[a:b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _BASE + w
            out.append(mix64(np.array([h])))
        else:
            out.append(rolled[:0])
        a = b
    return out


def set_class(s: np.ndarray) -> int:
    """64-bit digest of a set, signed."""
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def raw(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t is not None else b"" for t in texts]


def pack_set(s: np.ndarray) -> bytes:
    """A set for verification: the upper 48 bits of its sorted hashes, as differences, all first bytes first."""
    d = np.diff(s >> np.uint64(16), prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    d = np.zeros((len(b) // 6, 8), np.uint8)
    d[:, :6] = np.frombuffer(b, np.uint8).reshape(6, -1).T
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64) << np.uint64(16)


def survey(docs: DataFrame) -> DataFrame:
    """(id, n, cls) of every document, and with a null id the parts of each task's sketch (part, counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            texts, n, cls = raw(b["text"]), [], []
            for i, j in blocks(texts):
                sets = shingle_sets(texts[i:j])
                n += [len(s) for s in sets]
                cls += [set_class(s) if len(s) else None for s in sets]
                at = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                sketch += np.bincount(at, minlength=len(sketch)).astype(np.uint32)
            yield pd.DataFrame({"id": b["id"], "n": n, "cls": pd.array(cls, "Int64"), "part": None, "counts": None})
        parts = np.split(np.minimum(sketch, 255).astype(np.uint8), SKETCH_PARTS)
        yield pd.DataFrame({"id": None, "n": 0, "cls": None, "part": range(SKETCH_PARTS), "counts": [p.tobytes() for p in parts]})

    return docs.mapInPandas(trimmed(run), "id long, n long, cls long, part int, counts binary")


def merged_sketch(surveyed: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: 16 MB, whatever the input's size."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b["part"], b["counts"]):
                c = np.frombuffer(counts, np.uint8).astype(np.uint32)
                total[part] = total[part] + c if part in total else c
        yield pd.DataFrame({"part": list(total), "counts": [c.tobytes() for c in total.values()]})

    parts = surveyed.filter("part IS NOT NULL").select("part", "counts")
    rows = parts.repartition("part").mapInPandas(trimmed(add), "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def pack_rows(h: np.ndarray, cls: np.ndarray, pos: np.ndarray) -> bytes:
    """Prefix rows for the shuffle, in the order of their hashes: upper 48 bits as differences, class and position; numbers by bytes as in ``pack_set``."""
    at = np.argsort(h, kind="stable")
    where = np.ascontiguousarray(pos[at].astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pack_set(h[at]) + cls[at].astype(np.int64).tobytes() + where.tobytes()


def unpack_rows(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(b) // ROW_BYTES
    h = (unpack_set(b[:6 * k]) >> np.uint64(16)).astype(np.int64)
    pos = np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * k, 14 * k).reshape(4, -1).T).view(np.uint32).ravel()
    return h, np.frombuffer(b, np.int64, k, 6 * k), pos.astype(np.int32)


def prefix_rows(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(h, cls, pos): the rare-first prefix of every class, once per task at least, dealt by h.

    They are dealt in packed lots of up to ``LOT_ROWS``, by ranges of the hash, as
    most of them meet no other. Of a hash 48 bits go on: shingles that agree in
    them make a candidate more, which the sets refuse.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)       # fixed size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lots(hs: list, cs: list, ps: list) -> pd.DataFrame:
        h, c, p = np.concatenate(hs), np.concatenate(cs), np.concatenate(ps)
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        at = np.argsort(part, kind="stable")
        found, first = np.unique(part[at], return_index=True)
        return pd.DataFrame({"part": found, "lot": [pack_rows(h[i], c[i], p[i]) for i in np.split(at, first[1:])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sent = shared.value, set()
        hs, cs, ps, rows = [], [], [], 0
        for b in batches:
            texts = raw(b["text"])
            for i, j in blocks(texts):
                for s in shingle_sets(texts[i:j]):
                    n = len(s)
                    c = set_class(s) if n else None
                    if not n or c in sent:
                        continue
                    if len(sent) < SENT_CLASSES:
                        sent.add(c)
                    p = n - -(-percent * n // 100) + 1
                    often = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                    first = s[np.argsort(np.minimum(often, 0xFFFFF) << np.uint64(44) | s & np.uint64((1 << 44) - 1), kind="stable")[:p]]
                    hs.append(first)
                    cs.append(np.full(p, c, np.int64))
                    ps.append(np.arange(p, dtype=np.int32))
                    rows += p
                    if rows >= LOT_ROWS:
                        yield lots(hs, cs, ps)
                        hs, cs, ps, rows = [], [], [], 0
        if rows:
            yield lots(hs, cs, ps)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lot in b["lot"]:
                h, c, p = unpack_rows(lot)
                yield pd.DataFrame({"h": h, "cls": c, "pos": p})

    dealt = docs.mapInPandas(trimmed(run), "part int, lot binary").repartitionById(parts, "part")
    return dealt.mapInPandas(trimmed(unpack), "h long, cls long, pos int")


def shared_rows(prefixes: DataFrame) -> DataFrame:
    """Of prefix rows that are dealt by h those whose shingle more than one class sends, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = last_kept = None                          # the row before, not sent yet unless last_kept
        for b in batches:
            if last is not None:
                b = pd.concat([last, b], ignore_index=True)
            h, c = b["h"].to_numpy(), b["cls"].to_numpy()
            fresh = np.ones(len(b), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(fresh)
            h = h[at]
            same = h[1:] == h[:-1]
            shares = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last_kept and len(shares):
                shares[0] = False                        # was sent with the batch before
            known = len(at) > 1 and same[-1] or len(at) == 1 and bool(last_kept)
            out = b.iloc[at[shares]]
            if len(out):
                yield out
            last, last_kept = b.iloc[at[-1:]], known
        return

    # of shingles of a class with one hash the first counts: it lets the most candidates pass
    rows = prefixes.sortWithinPartitions("h", "cls", "pos")
    return rows.mapInPandas(trimmed(run), "h long, cls long, pos int")


def may_link(percent: int):
    """Length and positional filters on rows (n, pos) and (n2, pos2) that meet on a shingle."""
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent) - F.lit(1e-9))
    length = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    return length & (F.lit(1) + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) - F.lit(1) >= need)


def pairs_of(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of rows and others that meet on a shingle and may link, in different components."""
    o = others.select("h", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
    met = rows.join(o, "h").filter((F.col("comp") != F.col("comp2")) & may_link(percent))
    return met.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def common_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * common >= percent * union; a suffix filter comes before the intersection."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    edges = np.arange(1, SUFFIX_RANGES, dtype=np.uint64) << np.uint64(64 - SUFFIX_RANGES.bit_length() + 1)
    in_x = np.diff(np.searchsorted(x, edges), prepend=0, append=len(x))
    in_y = np.diff(np.searchsorted(y, edges), prepend=0, append=len(y))
    if np.minimum(in_x, in_y).sum() < need:
        return False
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum()) >= need


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""

    @pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_at_least(unpack_set(x), unpack_set(y), percent) for x, y in zip(a, b)], dtype=bool)

    p = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
    p = p.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    return p.filter(links("x", "y")).select("a", "b").distinct()


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bit per hash value of the ids (one column): 2 ** FILTER_BITS bits, whatever their number."""
    size = (1 << FILTER_BITS) // 8

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            seen[filter_place(b["id"].to_numpy())] = True
        yield pd.DataFrame({"part": range(SKETCH_PARTS), "bits": [x.tobytes() for x in np.split(np.packbits(seen), SKETCH_PARTS)]})

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, bits in zip(b["part"], b["bits"]):
                x = np.frombuffer(bits, np.uint8)
                total[part] = total[part] | x if part in total else x
        yield pd.DataFrame({"part": list(total), "bits": [x.tobytes() for x in total.values()]})

    kind = "part int, bits binary"
    out = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), np.uint8)
    for r in ids.mapInPandas(trimmed(mark), kind).repartition("part").mapInPandas(trimmed(union), kind).collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def filter_place(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, items): the sets of the documents with these ids (one column ``id``), and of a few others.

    The texts stay where they are: a filter of fixed size goes to them, which
    lets all wanted ids pass.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = filter_place(b["id"].to_numpy())
            texts = raw(b["text"][(bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)])
            for i, j in blocks(texts):
                sets = shingle_sets(texts[i:j])
                yield pd.DataFrame({"cls": [set_class(s) if len(s) else 0 for s in sets], "items": [pack_set(s) for s in sets]})

    return docs.mapInPandas(trimmed(run), "cls long, items binary")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id, n_links) of every document.

    ``class_id``: the smallest id with the same set; ``component_id``: the
    smallest id reachable by links; ``n_links``: verified links of the class to
    other classes (links inside a component need not all be verified).
    """
    spark = docs.sparkSession
    d = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    surveyed = store(survey(d), "survey")
    every = store(surveyed.filter("part IS NULL").select("id", "n", "cls"), "every")
    sketch = merged_sketch(surveyed)
    discard(surveyed)
    release(spark)
    shared = store(shared_rows(prefix_rows(d, sketch, percent)), "shared")
    release(spark)
    first = every.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("class_id"))
    sizes = every.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("class_id"), F.min("n").cast("int").alias("n"))
    comps = store(sizes.join(shared.select("cls").distinct(), "cls").withColumn("comp", F.col("class_id")), "classes")
    edges = []
    for k in range(STAR_ROUNDS + 1):
        rows = store(shared.join(comps, "cls"), "rows")
        # the smallest id of a group is its hub: more often than others what the rest are copies of
        hub = rows.groupBy("h").agg(F.min(F.struct("class_id", "cls", "n", "pos", "comp")).alias("hub"))
        last = False
        if k == 0:
            todo = pairs_of(rows, hub.select("h", "hub.*"), percent)
        else:
            outside = rows.join(hub.select("h", F.col("hub.comp").alias("hub_comp")), "h").filter("comp <> hub_comp").drop("hub_comp")
            outside = store(outside, "outside")
            size = rows.groupBy("h").count().join(outside.groupBy("h").agg(F.count(F.lit(1)).alias("out")), "h")
            open_rows, n_rows = size.agg(F.coalesce(F.sum(F.col("count") * F.col("out")), F.lit(0)), F.sum("count")).first()
            if not open_rows:
                break
            last = open_rows <= OPEN_SHARE * n_rows or k == STAR_ROUNDS
            second = outside.groupBy("h").agg(F.min(F.struct("class_id", "cls", "n", "pos", "comp")).alias("hub")).select("h", "hub.*")
            todo = pairs_of(rows, outside if last else second, percent)
            for t in tested:
                todo = todo.join(t, ["a", "b"], "left_anti")
        todo = store(todo, "pairs")
        tested = [todo] if k == 0 else [*tested, todo]
        met = todo.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = store(sets_of(d, comps.join(met, "cls").select(F.col("class_id").alias("id")).distinct()), "sets")
        release(spark)
        found = store(verified(todo, sets, percent), "verified")
        discard(sets)
        release(spark)
        edges.append(found)
        one, two = comps.select(F.col("cls").alias("a"), F.col("comp").alias("i")), comps.select(F.col("cls").alias("b"), F.col("comp").alias("j"))
        discard(rows)
        graph = components(found.join(one, "a").join(two, "b").select(F.col("i").alias("a"), F.col("j").alias("b")))
        joined = comps.join(graph.withColumnRenamed("id", "comp"), "comp", "left")
        comps = store(joined.select("cls", "class_id", "n", F.coalesce("component", "comp").alias("comp")), "classes")
        release(spark)
        if last:
            break
    edges = reduce(DataFrame.unionByName, edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    by_class = first.join(comps.select("cls", "comp"), "cls", "left").join(degree, "cls", "left")
    e = every.join(by_class, "cls", "left")
    out = e.select("id", "n", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("comp", "class_id", "id").alias("component_id"),
                   F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id", "n_links")


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest id stays.

    If ids repeat, every text of an id counts as a document of its own (in order
    of text hashes), so none is lost with another one of its id; rows that
    repeat id and text are one document and stay or go together.
    """
    key, columns = "doc_id", docs.columns
    known = docs.filter("doc_id IS NOT NULL")
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        key, version = fresh(docs, "row", "version")
        docs = docs.withColumn(version, F.xxhash64("text"))
        pairs = docs.filter("doc_id IS NOT NULL").select("doc_id", version).distinct()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = pairs.repartitionByRange(parts, "doc_id", version).sortWithinPartitions("doc_id", version)
        numbers = store(ranged.withColumn(key, F.monotonically_increasing_id()), "numbers")
        docs = store(docs.join(numbers, ["doc_id", version], "left"), "numbered")
    keep = jaccard_classes(docs, key).filter(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(keep, key, "left_anti").select(*[f"`{c}`" for c in columns])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("n_links")


#: The result of ``op3_ngram_jaccard_join`` in DuckDB SQL (all pairs that share a shingle, so for small tables).
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(generate_series(1, len(a) - 4), lambda i: array_to_string(a[i:i + 4], ' '))
        WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS m FROM s GROUP BY 1),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY m) AS class_id FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.seen = b.x),
k AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT k.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, k.doc_id) AS class_id, component_id
FROM k LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
