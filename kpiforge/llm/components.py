"""Connected components of a graph of ids, as Spark jobs over its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import discard, store

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Alternates the large-star and small-star steps, which rewire every id to the
    smallest neighbour seen so far, until every id points to its component. Each
    round is written to the shared folder; only two counts reach the driver.
    """
    links = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if is_star_forest(links):
            break
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        # large star: what is above an id goes to the id's smallest neighbour
        above = links.select(F.col("v").alias("id"), F.col("u").alias("above"))
        ids = links.select(F.col("v").alias("id")).distinct().join(low.withColumnRenamed("u", "id"), "id", "left")
        large = above.join(ids, "id").select(F.col("above").alias("u"), F.coalesce("m", "id").alias("v")).distinct()
        # small star: an id and what is below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        nxt = store(small, "links")
        discard(links)
        links = nxt
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def is_star_forest(links: DataFrame) -> bool:
    """Whether every id points to one smaller id that points nowhere."""
    more = links.groupBy("u").count().filter("count > 1").limit(1).count()
    return not more and not links.select("u").join(links.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
