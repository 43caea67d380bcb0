"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.scratch import keep


def _apart() -> Column:
    """Grouped by as well, this keeps a sum by node and the join with it in different exchanges.

    So Spark can split the join at a hub, a node with very many links, which it can't where the join
    reads the sum in place.
    """
    return (F.col("a") % 2).alias("z")


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) for every node of ``edges`` (a, b) but the smallest ones.

    Each step replaces edges by links to a smaller neighbour until every node links to the smallest of
    its component alone. The number of edges never grows, and the number of steps grows with the
    logarithm of the longest chain. Every step is written to the shared folder.
    """
    links = keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    before = None
    while (now := _print(links)) != before:
        before = now
        if not now[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a", _apart()).agg(F.least(F.min("b"), F.col("a")).alias("m")).drop("z")
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        parent = large.groupBy("a", _apart()).agg(F.min("b").alias("m")).drop("z")
        small = large.join(parent, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(parent.select("a", F.col("m").alias("b"))).distinct()
        links = keep(small, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
