"""Connected components of an edge table by alternating large and small stars.

Each round moves every node's larger neighbours, then its smaller ones, to the least node that
it knows of. Rounds are written to the shared folder; only a count and a checksum reach the
driver. A hub is aggregated before the shuffle (minimum per task), and its edges are joined by a
sort-merge join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's least node, from edges (a, b) of longs.

    Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # stable once every node has one edge, to a node that has none: nothing is left to move
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        edges = staged(_small(_large(edges).distinct()), "edges")
