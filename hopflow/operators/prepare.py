"""Graph preparation over edges (src, dst): loops, reversal, duplicates, degrees, adjacency and weights.

Ids are longs. Rows with a null end are no edges and are dropped by the operators that group; extra columns are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopflow.functions.vectors import applied
from hopflow.operators import ranking

#: Ids that one list of neighbours spans.
CHUNK = 1 << 16


def _vertices(edges: DataFrame, n: int) -> DataFrame:
    return edges.sparkSession.range(n)


def add_self_loops(edges: DataFrame, n: int) -> DataFrame:
    return edges.select("src", "dst").unionByName(_vertices(edges, n).select(F.col("id").alias("src"), F.col("id").alias("dst")))


def add_reverse_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every row, in one pass over the input."""
    both = F.array(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")), F.struct("src", "dst"))
    return edges.select(F.inline(both))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").dropDuplicates(["src", "dst"])


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").orderBy("src", "dst")


def prepare_graph(edges: DataFrame, n: int) -> DataFrame:
    """Undirected, looped and free of duplicates; the only shuffle is that of the duplicates."""
    return dedup_edges(add_reverse_edges(edges).unionByName(_vertices(edges, n).select(F.col("id").alias("src"), F.col("id").alias("dst"))))


def graph_stats(edges: DataFrame) -> DataFrame:
    top = F.greatest(F.max("src"), F.max("dst"))
    return edges.agg(F.count("*").alias("edges"), top.alias("max_id"), (top + 1).alias("vertices"))


def transpose_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _degree(edges: DataFrame, end: str, n: int, least: int) -> DataFrame:
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
    return _vertices(edges, n).join(counts, "id", "left").select("id", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(least)).cast("long").alias("degree"))


def out_degree(edges: DataFrame, n: int, least: int = 0) -> DataFrame:
    """Of every vertex in 0 .. n - 1; least = 1 for the clamped degrees that weights use."""
    return _degree(edges, "src", n, least)


def in_degree(edges: DataFrame, n: int, least: int = 0) -> DataFrame:
    return _degree(edges, "dst", n, least)


def undirected_degree(edges: DataFrame, n: int) -> DataFrame:
    return _degree(edges.select(F.explode(F.array("src", "dst")).alias("end")), "end", n, 0)


def offsets(degrees: DataFrame, page: int = ranking.PAGE) -> DataFrame:
    """(id, degree, offset): exclusive running sum of degrees in id order."""
    return ranking.running(degrees.select("id", "degree"), "degree", "offset", page=page).select("id", "degree", "offset")


def _adjacency(edges: DataFrame, key: str, other: str, n: int, chunk: int) -> DataFrame:
    lists = edges.groupBy(F.col(key).alias("id"), F.floor(F.col(other) / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(other)).alias("nbrs"))
    starts = offsets(_degree(edges, key, n, 0)).select("id", F.col("offset").alias("_start"))
    before = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = lists.withColumn("_before", F.coalesce(F.sum(F.size("nbrs")).over(before), F.lit(0)))
    both = starts.join(inside, "id", "left")
    return both.select("id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"), (F.col("_start") + F.coalesce("_before", F.lit(0))).alias("offset"))


def build_csc(edges: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """(id, chunk, nbrs, offset): sorted in-neighbours of each vertex, and where the list starts.

    A list holds the neighbours within one range of `chunk` ids, so a hub has several, in order of `chunk`; a vertex
    without neighbours has one empty list."""
    return _adjacency(edges, "dst", "src", n, chunk)


def build_csr(edges: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    return _adjacency(edges, "src", "dst", n, chunk)


def gcn_edge_weight(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, weight): 1 / (sqrt(out degree of src) * sqrt(in degree of dst)), degrees of 1 at least."""
    out, in_ = out_degree(edges, n, 1), in_degree(edges, n, 1)
    both = edges.join(out.select(F.col("id").alias("src"), F.col("degree").alias("od")), "src").join(in_.select(F.col("id").alias("dst"), F.col("degree").alias("id_")), "dst")
    return both.select("src", "dst", (1 / (F.sqrt("od") * F.sqrt("id_"))).alias("weight"))


def mean_edge_weight(edges: DataFrame, n: int) -> DataFrame:
    """The weights above divided by the number of in-edges of dst."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("c"))
    return gcn_edge_weight(edges, n).join(counts, "dst").select("src", "dst", (F.col("weight") / F.col("c")).alias("weight"))


def edge_weight_fn(edges: DataFrame, weight: Column | Callable) -> DataFrame:
    """weight: an expression over src and dst, or a numpy function of a batch of both."""
    if isinstance(weight, Column):
        return edges.select("src", "dst", weight.alias("weight"))
    return applied(edges.select("src", "dst"), weight, ["src", "dst"], "weight", "double")
