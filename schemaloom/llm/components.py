"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join with one row per node on one side;
nothing is gathered by node, and the driver only reads two numbers a round.
Every round is written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_spool, spool


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. In edges a > b holds."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: bigint) -> (node, root): root is the smallest node that node is connected to.

    Self-links, repeated and reversed edges are allowed; rows with a null end are
    ignored. Roots themselves and nodes without a link to another node have no row.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = spool(now, "edges")
    state = _state(now)
    while state[0]:
        after = spool(_small_star(_large_star(now)), "edges")
        drop_spool(now)
        before, now, state = state, after, _state(after)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
