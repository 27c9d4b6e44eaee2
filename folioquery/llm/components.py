"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace


def _checked(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node of its component; read
    from a table of work.

    Alternating large-star and small-star steps: each points a node's neighbours to the smallest
    node among them, until every node points to its root. Minima are partial aggregates and tables of
    their own, one row a node, so that a hub's neighbours are split between tasks when they are joined
    with it; nothing but a count and a checksum reaches the driver. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    e = work.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _checked(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = work.table(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = work.table(small.distinct(), "cc")
        before, state = state, _checked(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
