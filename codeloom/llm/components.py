"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from every node that has a link.

    ``links`` has long columns a and b; nulls and self links are ignored.  Each
    round is a few joins and partial aggregates on the node; its result is a
    table in the shared folder, so a lost executor costs one round at most.
    Rounds stop when the link set no longer changes (about log of the longest
    path).  Only a count and a checksum reach the driver.
    """
    links = save(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        n = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(n) == mark or not n[0]:
            break
        mark = tuple(n)
        links = save(_small_star(_large_star(links)), "links")
    low = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return low.union(low.select("component", "component").distinct())
