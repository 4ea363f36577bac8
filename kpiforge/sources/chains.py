"""Chains of landed pages (SRC-6, SRC-7, SRC-8): which pages count, and what is missing.

An API is read page by page until it says that there are no more. A landed
folder can hold a page twice (a retried fetch), lack one (a fetch that failed)
or hold pages behind the end (an earlier, longer fetch). ``numbered_chain``
checks pages with a number and a more-records flag, ``cursor_chain`` responses
that name the next one's cursor. Both return the pages that count, each once,
and a report with one row per chain:

* ``landed``: rows given; ``repeated``: rows that repeat a page;
* ``after_end``: further pages that do not belong to the chain;
* ``missing``: pages (numbered) or breaks (cursors) between first and last;
* ``complete``: nothing is missing and the last page says that it is the last.

Only page numbers and flags are compared; page contents move once, to keep one
row per page. Chains may be as long as they like: no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.facts import staged


def one_per_page(pages: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last landed row (by ``order``, then content) of each page, with the number of rows as ``_rows``."""
    rest = [c for c in pages.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(F.to_json(F.struct(*rest)))))
    picked = pages.groupBy(*keys).agg(last.alias("_last"), F.count(F.lit(1)).alias("_rows"))
    return picked.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest], "_rows")


def numbered_chain(pages: DataFrame, page: Column, more: Column, by: Sequence[str] = (), order: Sequence[str] = (),
                   first: int = 1) -> tuple[DataFrame, DataFrame]:
    """SRC-6 / SRC-7: pages numbered from ``first`` until one says that no more records follow.

    ``by``: columns that name a chain (e.g. the fetch); ``order``: columns that
    order landings, the last of a page wins. A NULL ``more`` means no more. The
    chain ends at its first page without more; rows with a NULL or smaller
    number belong to no chain and count as ``after_end``.
    """
    by = list(by)
    given = pages.select("*", page.cast("long").alias("_page"), F.coalesce(more, F.lit(False)).alias("_more"))
    once, _ = staged(one_per_page(given, [*by, "_page"], [F.col(c) for c in order]), "pages")
    valid = F.col("_page") >= first
    ends = once.groupBy(*by).agg(F.min(F.when(valid & ~F.col("_more"), F.col("_page"))).alias("_end"),
                                 F.max(F.when(valid, F.col("_page"))).alias("_max"))
    marked = _with(once, ends, by).withColumn("_in", F.coalesce(valid & (F.col("_page") <= F.coalesce("_end", "_max")), F.lit(False)))
    missing = F.coalesce("_end", "_max") - first + 1 - F.col("n")
    report = marked.groupBy(*by).agg(
        F.sum("_rows").alias("landed"), F.sum(F.col("_rows") - 1).alias("repeated"), F.count_if(~F.col("_in")).alias("after_end"),
        F.count_if("_in").alias("n"), F.max("_end").alias("_end"), F.max("_max").alias("_max")).select(
        *by, "landed", "repeated", "after_end", F.coalesce(missing, F.lit(0)).cast("long").alias("missing"),
        (F.col("_end").isNotNull() & (missing == 0)).alias("complete"))
    return marked.where("_in").select(*pages.columns), report


def missing_pages(pages: DataFrame, page: Column, more: Column, by: Sequence[str] = (), first: int = 1) -> DataFrame:
    """(by, from_page, to_page): the runs of missing pages of ``numbered_chain``.

    A run follows a page whose successor is absent and precedes one whose
    predecessor is: two joins on neighbours find these few, a window pairs them.
    """
    from pyspark.sql import Window
    by = list(by)
    p = pages.select(*by, page.cast("long").alias("p"), F.coalesce(more, F.lit(False)).alias("m")).where(F.col("p") >= first)
    ends = p.groupBy(*by).agg(F.coalesce(F.min(F.when(~F.col("m"), F.col("p"))), F.max("p")).alias("_end"))
    have = _with(p, ends, by).where(F.col("p") <= F.col("_end")).select(*by, "p", "_end").distinct()
    have = have.unionByName(ends.select(*by, F.lit(first - 1).cast("long").alias("p"), "_end"))
    edge = lambda step: have.join(have.select(*by, (F.col("p") + step).alias("p")), [*by, "p"], "left_anti")
    before = edge(-1).where(F.col("p") < F.col("_end")).select(*by, "p", F.lit(False).alias("_after"))     # successor is absent
    after = edge(1).where(F.col("p") >= first).select(*by, "p", F.lit(True).alias("_after"))
    w = Window.partitionBy(*by).orderBy("p", F.desc("_after"))
    runs = before.unionByName(after).withColumn("_next", F.lead("p").over(w))
    return runs.where(~F.col("_after")).select(*by, (F.col("p") + 1).alias("from_page"), (F.col("_next") - 1).alias("to_page"))


def cursor_chain(responses: DataFrame, cursor: Column, next_cursor: Column, more: Column, by: Sequence[str] = (),
                 order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC-8: responses linked by cursors, the first asked for without one.

    ``cursor``: what a response was asked for with. A response that says it has
    more but names no cursor, or one that nothing answered, is a break
    (``missing``). Responses that no other leads to belong to the chain if it
    has a break (they follow it), and are ``after_end`` if it ends regularly.
    Starts are found by pointer doubling, in rounds logarithmic in the chain's
    length. Cursors are compared without the contents; these are compared and
    stored of repeated responses alone, and the rest is read where it is wanted.
    """
    by = list(by)
    given = responses.select("*", cursor.alias("_cursor"), F.when(F.coalesce(more, F.lit(False)), next_cursor).alias("_next"),
                             F.coalesce(more, F.lit(False)).alias("_more"))
    keys, seen = [*by, "_cursor"], F.count(F.lit(1)).alias("_rows")
    told, _ = staged(given.groupBy(*keys).agg(F.min("_next").alias("_next"), F.max("_more").alias("_more"), seen), "told")
    again, _ = staged(told.where(F.col("_rows") > 1).select(*keys), "again")
    picked, _ = staged(one_per_page(_matching(given, again, keys, "left_semi"), keys, [F.col(c) for c in order]), "responses")
    links, _ = staged(told.where(F.col("_rows") == 1).unionByName(picked.select(*told.columns)).withColumnRenamed("_cursor", "node"), "links")
    led = links.where(F.col("_next").isNotNull()).select(*by, F.col("_next").alias("node"), F.coalesce("node", F.lit("")).alias("up")).dropDuplicates([*by, "node"])
    # the empty name stands for the first response, which has no cursor
    jump = links.select(*by, F.coalesce("node", F.lit("")).alias("node")).join(led, [*by, "node"], "left")
    jump, _ = staged(jump.select(*by, "node", F.coalesce("up", "node").alias("up")), "jumps")
    while True:
        onward = jump.select(*by, F.col("node").alias("up"), F.col("up").alias("_far"))
        further = jump.join(onward, [*by, "up"], "left").select(*by, "node", "up", F.coalesce("_far", "up").alias("_far"))
        further, _ = staged(further, "jumps")
        done = further.where(F.col("up") != F.col("_far")).isEmpty()
        jump = further.select(*by, "node", F.col("_far").alias("up"))
        if done:
            break
    answered = links.select(*by, F.col("node").alias("_next")).where(F.col("_next").isNotNull()).withColumn("_answered", F.lit(True))
    state = links.withColumn("node", F.coalesce("node", F.lit(""))).join(jump, [*by, "node"]).join(answered, [*by, "_next"], "left")
    state = state.withColumns({"_head": F.col("up") == "", "_break": F.col("_more") & F.col("_answered").isNull()})
    ends = state.groupBy(*by).agg(F.max(F.col("_head") & ~F.col("_more")).alias("_ended"))
    state = _with(state, ends, by).withColumn("_in", F.col("_head") | ~F.col("_ended"))
    report = state.groupBy(*by).agg(
        F.sum("_rows").alias("landed"), F.sum(F.col("_rows") - 1).alias("repeated"), F.count_if(~F.col("_in")).alias("after_end"),
        # without a first response the chain lacks its start
        (F.count_if(F.col("_in") & F.col("_break")) + F.when(F.max("_head"), 0).otherwise(1)).alias("missing"),
        (F.max("_ended") & F.max("_head")).alias("_ok"))
    # what does not count is mostly little, so that the contents need not move
    out, _ = staged(state.where(~F.col("_in")).select(*by, F.col("node").alias("_node")), "out")
    once = _matching(given, again, keys, "left_anti").select(*responses.columns, "_cursor").unionByName(
        picked.select(*responses.columns, "_cursor"))
    of_chain = reduce(and_, [F.col(c).isNotNull() for c in by], F.lit(True))
    kept = once.where(of_chain).withColumn("_node", F.coalesce("_cursor", F.lit(""))).join(out, [*by, "_node"], "left_anti").select(*responses.columns)
    return kept, report.select(*by, "landed", "repeated", "after_end", F.col("missing").cast("long").alias("missing"),
                               (F.col("_ok") & (F.col("missing") == 0)).alias("complete"))


def _matching(rows: DataFrame, names: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) their keys among the names; null matches null."""
    n = names.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    return rows.join(n, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]), how)


def _with(rows: DataFrame, per_chain: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their chain; without ``by`` there is one chain."""
    return rows.join(per_chain, by) if by else rows.crossJoin(F.broadcast(per_chain))      # one row by construction
