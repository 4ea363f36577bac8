"""Line dedup by overlapping three-line windows.

Every run of ``size`` consecutive lines with a word is hashed (128 bits);
windows that occur more than once anywhere are found by one pre-aggregated
shuffle, the occurrences after the first (smallest id, then place) are
removed, overlapping ones merged.

Special input: null and empty texts, and texts with fewer lines than a
window, stay as they are; rows with a null id are neither compared nor
changed; rows that repeat id and text count as one document, so they keep
the same lines; texts that share an id are documents of their own, in order of
their hashes; blank lines are skipped in windows, and go only when the
lines on both sides go; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import fresh, table, trimmed

WINDOW = 3
BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_windows(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, version, pos, h1, h2): each window of ``size`` lines with a word; ``pos`` counts those lines from 0, and
    ``version`` is a hash of the text."""
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: F.regexp_replace(x, BLANKS, "")),
                     lambda x: x != "")
    w = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), lines.alias("lines")).filter(
        F.col("id").isNotNull() & (F.size("lines") >= size))
    at = F.sequence(F.lit(0), F.size("lines") - size)

    def digest(i):
        run = [F.element_at(F.col("lines"), i + k + 1) for k in range(size)]
        return F.struct(F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("second"), *run[::-1]).alias("h2"))

    return w.select("id", "version", F.posexplode(F.transform(at, digest)).alias("pos", "h")).select("id", "version", "pos", "h.h1", "h.h2")


def repeated_occurrences(windows: DataFrame) -> DataFrame:
    """(id, version, pos) of every window that occurs earlier, in id and place order."""
    place = F.struct("id", "version", "pos")
    seen = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    seen = seen.filter(F.col("first") < F.col("last")).select("h1", "h2", "first")
    later = windows.join(seen, ["h1", "h2"]).filter(place > F.col("first"))
    return later.select("id", "version", "pos")


def without_lines(text: str, places: np.ndarray, size: int) -> tuple[str, int, int]:
    """The text without the lines of the windows at ``places``; lines and merged spans removed."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    mark = np.zeros(len(full) + 1, np.int64)
    for p in places:
        mark[p] += 1
        mark[p + size] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    removed, spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    drop = set()
    for k in np.flatnonzero(gone):
        drop.add(full[k])
        if k + 1 < len(full) and gone[k + 1]:
            drop.update(range(full[k], full[k + 1]))
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), removed, spans


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "line_dedup",
               size: int = WINDOW) -> DataFrame:
    """Replace ``text`` by what stays; add struct ``out`` (n_lines, n_removed, n_spans)."""
    later = repeated_occurrences(line_windows(docs, id_col, text, size))
    key, version, spots_col, cut = fresh(docs, "id", "version", "spots", "cut")
    spots = later.groupBy(F.col("id").alias(key), F.col("version").alias(version)).agg(F.collect_set("pos").alias(spots_col))

    @pandas_udf("text string, n_removed long, n_spans long")
    @trimmed
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            yield pd.DataFrame([(t, 0, 0) if p is None or t is None else without_lines(t, np.asarray(p), size)
                                for t, p in zip(texts, places)], columns=["text", "n_removed", "n_spans"])

    t = F.col(f"`{text}`")
    n_lines = F.when(t.isNull(), 0).otherwise(F.size(F.split(t, "\n", -1))).cast("long")
    joined = docs.join(spots, (F.col(f"`{id_col}`") == F.col(key)) & (F.xxhash64(t) == F.col(version)), "left")
    touched = F.col(spots_col).isNotNull()
    done = joined.withColumn(cut, F.when(touched, apply(F.when(touched, t), F.col(spots_col))))   # other texts stay in the JVM
    info = F.struct(n_lines.alias("n_lines"), F.coalesce(f"{cut}.n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce(f"{cut}.n_spans", F.lit(0)).cast("long").alias("n_spans"))
    done = done.withColumn(out, info).withColumn(text, F.when(F.col(cut).isNull(), t).otherwise(F.col(cut)["text"]))
    return done.drop(key, version, spots_col, cut)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated line windows go; so does a document of which nothing is left."""
    (out,) = fresh(docs, "line_dedup")
    cut = line_dedup(docs, out=out).filter((F.col(out)["n_removed"] == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(F.col(out)["n_removed"] > 0, F.length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).drop(out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), out="d")
    return d.select("doc_id", "d.n_lines", "d.n_removed", "d.n_spans",
                    F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: The result of ``op10_line_dedup`` in DuckDB SQL.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM x),
f AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM t WHERE s <> ''),
w AS (SELECT doc_id, pos, s, lead(s, 1) OVER d AS s1, lead(s, 2) OVER d AS s2 FROM f
      WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id, pos) AS nth
                                   FROM w WHERE s2 IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) v(k)),
g AS (SELECT f.doc_id, f.i, f.pos, gone.pos IS NOT NULL AS cut FROM f LEFT JOIN gone USING (doc_id, pos)),
h AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM g),
n AS (SELECT doc_id, count_if(cut) AS n_removed, count_if(cut AND NOT before) AS n_spans FROM h GROUP BY 1),
y AS (SELECT x.doc_id, x.line, x.i,
        last_value(h.cut IGNORE NULLS) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
        first_value(h.cut IGNORE NULLS) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down
      FROM x LEFT JOIN h USING (doc_id, i)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM y WHERE NOT (coalesce(up, false) AND coalesce(down, false)) GROUP BY 1)
SELECT l.doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
