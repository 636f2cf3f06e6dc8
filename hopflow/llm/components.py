"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest member of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them. Edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): v is the smallest node that u reaches; one row for each node but the smallest of its component.

    edges: columns u, v of a sortable type, any order, repeats allowed. Counts are made on the map side and the joins
    back to edges can be split, so a hub does not meet in one task. The number of rounds grows with the logarithm of
    the nodes; each round is written to the shared folder."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = written(now, name)
    before = None
    while True:
        state = _state(now)
        if state == before or not state[0]:
            return now
        before = state
        now = written(_small_star(_large_star(now)), name)
