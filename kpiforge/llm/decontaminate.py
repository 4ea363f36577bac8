"""Benchmark decontamination over item-sized windows.

Column functions only. Words (lower case A-Z, without ASCII punctuation) form
five-word shingles. A window of a document is as long as the item that it is
held against; of a document shorter than the item it is the whole document.

1. Windows are taken where enough shingles occur in some item of that length:
   windows of m and s shingles that are similar to degree t share at least
   t (m + s) / (1 + t) of them, so this step loses nothing.
2. The 64-bit SimHash of a window, in which a repeated shingle weighs as often
   as it occurs, is cut into ``BLOCKS`` blocks. Fingerprints within ``RADIUS``
   bits have a block with at most RADIUS // BLOCKS differing bits, so a lookup of
   all such block values of the items meets every fingerprint within the radius;
   a pair that several blocks meet is taken in the first of them.
3. The exact weighted Jaccard similarity over the shingles decides.

At similarity 0.75 the distance is about 11 bits with a deviation of 3, so a
radius of 23 lies four deviations off; the tests measure the recall.

Special input: a null or empty text has no match; an item with fewer words than
a shingle matches nothing; rows with a null document or item id are left out;
rows that repeat an id are one document (matched if any of them is); among
equally similar windows the nearest, then the first is reported; an empty table
on either side gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm.common import SPACES, UPPER, store, table

SHINGLE = 5
SIMILARITY = 0.75
RADIUS, BLOCKS = 23, 6
#: Benchmarks with at most this many shingles (16 bytes each) and items (some 1,300 block values each) are broadcast;
#: larger ones are shuffled.
BROADCAST_SHINGLES, BROADCAST_ITEMS = 500_000, 1_500
#: ASCII punctuation, which is left out of words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def block_layout(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, width) of each block of the 64 bits."""
    base, more = divmod(64, blocks)
    out, shift = [], 0
    for k in range(blocks):
        out.append((shift, base + (k < more)))
        shift += out[-1][1]
    return out


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Array of the hashes of the n-word shingles of a text, in order."""
    clean = F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, UPPER.lower())
    words = F.filter(F.split(clean, SPACES), lambda w: w != "")
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= n, F.transform(
        F.sequence(F.lit(0), F.size(ws) - n),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))[0]


def simhash(window: str) -> Column:
    """64-bit SimHash of an array of hashes: the majority of each bit."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (sig, b) -> sig | IF(2 * aggregate({window}, 0, "
                  f"(c, h) -> c + CAST(getbit(h, b) AS INT)) > size({window}), shiftleft(1L, b), 0L))")


def weighted_jaccard(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of hashes, each hash weighing as often as it occurs."""
    both = (f"aggregate(array_distinct({b}), 0, (s, x) -> s + "
            f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    return F.expr(f"CAST({both} AS DOUBLE) / (size({a}) + size({b}) - {both})")


def benchmark_items(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item, size, item_shingles, item_sig) of every item that has a shingle."""
    b = benchmark.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("item"), shingles(F.col(f"`{text}`")).alias("item_shingles")).distinct()
    b = b.withColumn("size", F.size("item_shingles")).filter("size > 0")
    return b.withColumn("item_sig", simhash("item_shingles"))


def candidate_starts(docs: DataFrame, items: DataFrame, similarity: float, small: bool) -> DataFrame:
    """(doc, size, starts): window starts, by size, that hold enough shingles of items of that size."""
    of_items = items.select(F.explode("item_shingles").alias("h"), "size").distinct()
    found = docs.select("doc", F.size("doc_shingles").alias("n"), F.posexplode("doc_shingles").alias("pos", "h")).join(
        F.broadcast(of_items) if small else of_items, "h")
    # the longest of the texts that share an id bounds the starts; windows beyond a shorter one's end are cut there
    at = found.groupBy("doc", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.max("n").alias("n"), F.min("n").alias("m"))
    share = F.lit(similarity / (1 + similarity))
    at = at.withColumn("need", F.greatest(F.lit(1), F.ceil(share * (F.least("m", "size") + F.col("size")) - F.lit(1e-9)).cast("int")))
    # the window that starts in (previous hit, this hit] holds `need` hits if it reaches the need-th hit from here
    starts = F.expr("""flatten(transform(sequence(1, size(at) - need + 1), i ->
        coalesce(get(transform(filter(array(struct(
            greatest(IF(i = 1, 0, element_at(at, IF(i = 1, 1, i - 1)) + 1), element_at(at, i + need - 1) - size + 1) AS lo,
            element_at(at, i) AS hi)), r -> r.lo <= r.hi), r -> sequence(r.lo, r.hi)), 0), CAST(array() AS array<int>))))""")
    return at.filter("size(at) >= need").select("doc", "size", starts.alias("starts"))


def probes(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(size, block, value, item, item_sig): block values within radius // blocks bits of each item's."""
    def listed(k: int, shift: int, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for n in range(radius // blocks + 1) for bits in combinations(range(width), n)]
        value = F.shiftrightunsigned("item_sig", shift).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                           lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    near = F.concat(*[listed(k, shift, width) for k, (shift, width) in enumerate(block_layout(blocks))])
    return items.select("size", "item", "item_sig", F.explode(near).alias("p")).select(
        "size", "p.block", "p.value", "item", "item_sig")


def met_within(windows: DataFrame, items: DataFrame, radius: int, blocks: int, small: bool) -> DataFrame:
    """Windows with (item, item_sig, distance) of each item of their size whose fingerprint is within the radius."""
    layout = block_layout(blocks)
    values = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("sig", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
                       for k, (shift, width) in enumerate(layout)])
    listed = probes(items, radius, blocks)
    cut = windows.select("*", F.explode(values).alias("x")).select("*", "x.block", "x.value").drop("x")
    pairs = cut.join(F.broadcast(listed) if small else listed, ["size", "block", "value"])
    differs = F.col("sig").bitwiseXOR(F.col("item_sig"))
    first = F.coalesce(*[F.when(F.bit_count(differs.bitwiseAND(F.lit(_signed((1 << width) - 1 << shift)))) <= radius // blocks, k)
                         for k, (shift, width) in enumerate(layout)])
    met = pairs.filter((F.bit_count(differs) <= radius) & (F.col("block") == first))
    return met.withColumn("distance", F.bit_count(differs)).drop("block", "value")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document and item that it holds: (id_col, item_col, start, n_words, similarity, distance) of the best window."""
    items = store(benchmark_items(benchmark, item_col, item_text), "items")
    small = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= BROADCAST_SHINGLES
    d = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("t"))
    places = store(candidate_starts(d.select("doc", shingles(F.col("t")).alias("doc_shingles")), items, similarity, small), "places")
    again = places.join(d, "doc").select("doc", "size", "starts", shingles(F.col("t")).alias("doc_shingles"))
    last = F.greatest(F.lit(0), F.size("doc_shingles") - F.col("size"))
    starts = F.array_distinct(F.transform("starts", lambda s: F.least(s, last)))
    windows = again.select("doc", "size", F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.slice("doc_shingles", s + 1, F.col("size")).alias("w")))).alias("x")).select(
        "doc", "size", "x.start", "x.w").filter(F.size("w") > 0)
    few = small and items.count() <= BROADCAST_ITEMS
    met = met_within(windows.withColumn("sig", simhash("w")), items, RADIUS, BLOCKS, few)
    what = items.select("item", "item_sig", "item_shingles")
    scored = met.join(F.broadcast(what) if small else what, ["item", "item_sig"]).withColumn(
        "similarity", weighted_jaccard("w", "item_shingles")).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("doc", "item").agg(F.max(F.struct(
        "similarity", (-F.col("distance")).alias("near"), (-F.col("start")).alias("early"), F.size("w").alias("held"))).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.early")).cast("long").alias("start"),
                       (F.col("b.held") + (SHINGLE - 1)).cast("long").alias("n_words"),
                       F.col("b.similarity").alias("similarity"), (-F.col("b.near")).cast("int").alias("distance"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
