"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves; every source has a tree, and the roots of the sources are the
leaves of one more tree. A node's label is (level, place); digests are messages
to the parent's label, taken from a priority queue in label order. The queue's
external part is Spark's sorting shuffle: blocks of ``ARITY ** LEVELS``
consecutive nodes arrive sorted by (tree, block, place), so a task holds the
heap of one block at a time and sends one digest a block to the next round. Any
source, however large, is thus many blocks. A reversed sweep then takes the
rounds from the root down: a block receives what follows its root on the way to
the manifest's root, once, and delivers each node's proof suffix.

Places come from a range-partitioned sort by (source, id, digest) with row
counts per partition and source, so no task or window holds a source.

Special input: a null in any column is a value of its own (``-`` in the digest,
null source and id first); empty and very long texts are hashed in the JVM;
rows that repeat an id are leaves of their own, in order of their digests; rows
that repeat wholly have equal leaves side by side and their own proofs; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import discard, store, table

ARITY = 3
#: Levels that a round climbs: a block has at most ARITY ** LEVELS nodes.
LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(columns: Sequence[Column]) -> Column:
    """Hex digest of a row: each value as its byte count, a colon and itself; a null as a dash."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def parent_digest(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(first: int, digests: Sequence[str], levels: int) -> list[tuple[int, int, str]]:
    """All nodes (level, place, digest) of a block whose nodes start at place ``first``, in label order.

    A heap ordered by label: what leaves it is complete, and siblings leave one after the other.
    """
    queue = [(0, first + k, d) for k, d in enumerate(digests)]       # in order, hence a heap
    nodes: list[tuple[int, int, str]] = []
    while queue:
        level, place, digest = heapq.heappop(queue)
        nodes.append((level, place, digest))
        if level == levels:
            continue
        run = [digest]
        while queue and queue[0][0] == level and queue[0][1] // ARITY == place // ARITY:
            nodes.append(heapq.heappop(queue))
            run.append(nodes[-1][2])
        heapq.heappush(queue, (level + 1, place // ARITY, parent_digest(run)))
    return nodes


def suffixes(first: int, digests: Sequence[str], levels: int, above: str) -> list[str]:
    """Way of each node of a block up to the manifest's root, in order of place.

    A way has an entry a level, ended by ``/``: the digests left of the path, ``*`` for the path, those right of it.
    """
    rows: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for level, place, digest in climb(first, digests, levels):
        rows.setdefault((level, place // ARITY), []).append((place, digest))
    way = {(levels, first // ARITY ** levels): above}
    for (level, up), run in sorted(rows.items(), reverse=True):         # from the root down
        if level == levels:
            continue
        for k, (place, _) in enumerate(run):
            others = [d for _, d in run]
            others[k] = "*"
            way[level, place] = "".join(others) + "/" + way[level + 1, up]
    return [way[0, first + k] for k in range(len(digests))]


def fold(leaf: str, way: str) -> str:
    """Root that a leaf and its way give."""
    for entry in way.split("/")[:-1]:
        leaf = parent_digest([entry.replace("*", leaf)])
    return leaf


def proof_digest(way: str) -> str:
    """Digest of all siblings on a way, left to right and level by level."""
    return parent_digest([way.replace("*", "").replace("/", "")])


def placed(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0 within ``tree``, in order of ``keys``) and ``n`` (leaves of the tree)."""
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = leaves.withColumn("row", F.monotonically_increasing_id())     # tells rows that repeat wholly apart
    order = ["tree", *keys, "row"]
    ranged = numbered.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
    ranged = store(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "leaves")
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("size"))
    w = Window.partitionBy("tree")
    runs = runs.withColumns({"n": F.sum("size").over(w), "before": F.sum("size").over(
        w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")}).drop("size")
    done = ranged.join(runs, ["tree", "part"]).withColumn("place", F.col("at") - F.col("least") + F.col("before"))
    out = store(done.drop("part", "at", "least", "before"), "placed")
    discard(ranged)
    return out


def sorted_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``block``, all of a block in one partition and in label order."""
    b = nodes.withColumn("block", F.floor(F.col("place") / ARITY ** LEVELS).cast("long"))
    return b.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def in_blocks(batches: Iterator[pd.DataFrame], work: Callable[[tuple, list[tuple]], list[tuple]],
              columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Apply ``work`` to the rows of each block of sorted batches; a block is held whole, nothing else is."""
    held: list[tuple] = []
    done: list[tuple] = []
    key = None
    for b in batches:
        for k, rows in groupby(b.itertuples(index=False, name=None), key=lambda r: r[:2]):
            if k != key and held:
                done += work(key, held)
                held = []
            key = k
            held += rows
        if len(done) > 10_000:
            yield pd.DataFrame(done, columns=columns)
            done = []
    if held:
        done += work(key, held)
    if done:
        yield pd.DataFrame(done, columns=columns)


def roots_of_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, place, n, digest) one round up: the root of each block."""
    kind = "tree string, place long, n long, digest string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(key, rows):
            n = rows[0][3]
            levels = min(LEVELS, height(n))
            _, place, digest = climb(rows[0][2], [r[4] for r in rows], levels)[-1]
            return [(key[0], place, -(-n // ARITY ** LEVELS), digest)]
        return in_blocks(batches, work, ["tree", "place", "n", "digest"])

    rows = sorted_blocks(nodes.select("tree", "place", "n", "digest"))
    return rows.select("tree", "block", "place", "n", "digest").mapInPandas(run, kind)


def ways_down(nodes: DataFrame, above: DataFrame, last: bool) -> DataFrame:
    """Deliver the ways of a round's blocks to its nodes. ``above``: (tree, place, way, subroot, root) by block.

    With ``last`` the nodes are leaves with a ``tampered`` digest, and their proofs are returned instead.
    """
    kind = ("id string, leaf string, subroot string, root string, proof string, folded string" if last else
            "tree string, place long, way string, subroot string, root string")
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(key, rows):
            (_, _, _, _, _, way, subroot, root, _, _), *rest = rows         # the message precedes the nodes
            digests = [r[4] for r in rest]
            ways = suffixes(rest[0][2], digests, min(LEVELS, height(rest[0][3])), way)
            if not last:
                return [(key[0], r[2], w, subroot, root) for r, w in zip(rest, ways)]
            return [(r[8], r[4], subroot, root, proof_digest(w), fold(r[9] or r[4], w)) for r, w in zip(rest, ways)]
        return in_blocks(batches, work, names)

    block = F.floor(F.col("place") / ARITY ** LEVELS).cast("long")
    none = F.lit(None).cast("string")
    extra = ["id", "tampered"] if last else [none.alias("id"), none.alias("tampered")]
    own = nodes.select("tree", block.alias("block"), "place", "n", "digest", none.alias("way"), none.alias("subroot"),
                       none.alias("root"), *extra)
    message = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"),
                           none.alias("digest"), "way", "subroot", "root", none.alias("id"), none.alias("tampered"))
    rows = own.unionByName(message).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return rows.mapInPandas(run, kind)


def rounds_up(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored nodes of every round, and (tree, digest) of the trees' roots."""
    rounds, found = [leaves], []
    while True:
        up = store(roots_of_blocks(rounds[-1]), "blocks")
        found.append(up.filter("n = 1"))
        rest = up.filter("n > 1")
        if rest.isEmpty():
            break
        rounds.append(rest)
    roots = found[0]
    for f in found[1:]:
        roots = roots.unionByName(f)
    return rounds, roots.select("tree", "digest")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: Sequence[str] = COLUMNS,
                    tampered: DataFrame | None = None, tampered_digest: Column | None = None) -> DataFrame:
    """A row per document: (id_col, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``tampered_digest``: digest of the row as found later, null where it is as it was; ``folded_root`` is then
    recomputed from it and the original siblings.
    """
    col = [F.col(f"`{c}`") for c in columns]
    source = F.col(f"`{source_col}`")
    id_type = docs.schema[id_col].dataType
    later = F.lit(None).cast("string") if tampered_digest is None else tampered_digest
    leaves = docs.select(F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("tree"),
                         F.col(f"`{id_col}`").alias("key"), row_digest(col).alias("digest"), later.alias("tampered"))
    leaves = store(leaves, "rows")
    every = placed(leaves, ["key", "digest"])
    discard(leaves)
    rounds, subroots = rounds_up(every.withColumn("id", F.col("key").cast("string")))
    top = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    top_rounds, root = rounds_up(top)
    # down: what follows the root is nothing; the sources' roots hand their ways to their trees
    whole = root.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("way"),
                        F.lit("").alias("subroot"), F.col("digest").alias("root"))
    ways = whole
    for nodes in reversed(top_rounds):
        ways = store(ways_down(nodes, ways, False), "ways")
    names = top.select("place", F.col("source").alias("tree"), F.col("digest").alias("subroot"))
    ends = store(ways.drop("tree", "subroot").join(names, "place").select(
        "tree", F.lit(0).cast("long").alias("place"), "way", "subroot", "root"), "ends")
    ways = None
    for nodes in reversed(rounds[1:]):
        # a tree's way enters in the round in which the tree has one block
        here = ends.join(nodes.select("tree", "n").filter(F.col("n") <= ARITY ** LEVELS).select("tree").distinct(), "tree", "left_semi")
        ways = here if ways is None else here.unionByName(ways)
        ways = store(ways_down(nodes, ways, False), "ways")
    small = ends.join(rounds[1].select("tree").distinct(), "tree", "left_anti") if len(rounds) > 1 else ends
    done = ways_down(rounds[0], small if ways is None else small.unionByName(ways), True)
    return done.select(F.col("id").cast(id_type).alias(id_col), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    cut = F.translate("text", "\n", "")
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    later = row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), cut])
    return merkle_manifest(docs, tampered_digest=F.when(changed, later))


#: The result of ``op11_merkle_manifest`` in DuckDB SQL; ``bits`` are the steps of CRC-32 over the digits of an id.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))) AS bits
  FROM documents),
e AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    replace(text, chr(10), '') AS cut,
    list_reduce(bits, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) & 1 = 1 AS even
  FROM d),
l AS (SELECT doc_id, tree, leaf, CASE WHEN even THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE leaf END AS found,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM e),
up AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY tree, level, place // 3),
s AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, place, n, digest FROM s
  UNION ALL
  SELECT level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM top WHERE n > 1 GROUP BY level, place // 3),
near AS (SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
far AS (SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY 1, 2),
w AS (
  SELECT tree, place AS p0, 0 AS level, place, '' AS proof, found AS folded FROM l
  UNION ALL
  SELECT tree, p0, level + 1, w.place // 3, proof || lft || rgt, sha256(lft || folded || rgt) FROM w JOIN near USING (tree, level, place)),
w1 AS (SELECT tree, p0, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM w GROUP BY 1, 2),
v AS (
  SELECT tree, p0, 0 AS level, s.place, proof, folded FROM w1 JOIN s USING (tree)
  UNION ALL
  SELECT tree, p0, level + 1, v.place // 3, proof || lft || rgt, sha256(lft || folded || rgt) FROM v JOIN far USING (level, place)),
v1 AS (SELECT tree, p0, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM v GROUP BY 1, 2)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM l JOIN v1 ON l.tree = v1.tree AND l.place = v1.p0 JOIN s ON s.tree = l.tree CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""
