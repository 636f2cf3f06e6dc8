"""Contiguous vertex ranges of balanced work, edge ownership and mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopflow.operators.prepare import out_degree
from hopflow.sources.scratch import written


def balanced_ranges(edges: DataFrame, n: int, parts: int, page: int = 1024, alpha: int | None = None, book: int = 4096) -> list[tuple[int, int, int]]:
    """(part, lo, hi) of `parts` ranges of ids. The work of a vertex is its out-degree + alpha (12 * (parts + 1)).

    A range ends at the first vertex where its work exceeds the remaining work over the remaining parts, floored to a
    page, so sums by page decide exactly. They are written, and added up by book of `book` pages; the driver reads one
    row for each book, and the pages of the book in which a range ends."""
    alpha = 12 * (parts + 1) if alpha is None else alpha
    work = out_degree(edges, n).groupBy(F.floor(F.col("id") / page).alias("p")).agg(F.sum(F.col("degree") + alpha).alias("w"))
    pages = written(work.withColumn("b", F.floor(F.col("p") / book)), "page_work")
    books = {r["b"]: r["w"] for r in pages.groupBy("b").agg(F.sum("w").alias("w")).collect()}
    last = -(-n // page)
    before, total = {}, 0  # work in the books before each book
    for b in range(-(-last // book)):
        before[b] = total
        total += books.get(b, 0)

    def end(limit: float) -> tuple[int, int]:
        """The first page at whose end more than `limit` work has been met, and the work before it."""
        b = max((k for k, w in before.items() if w <= limit), default=0)
        got, found = before.get(b, 0), {r["p"]: r["w"] for r in pages.filter(F.col("b") == b).select("p", "w").collect()}
        for p in range(b * book, min((b + 1) * book, last)):
            if got + found.get(p, 0) > limit:
                return p, got
            got += found.get(p, 0)
        return min((b + 1) * book, last), got

    start, done, out = 0, 0, []
    for part in range(parts):
        if part == parts - 1:
            out.append((part, min(start * page, n), n))
            break
        stop, met = end(done + (total - done) / (parts - part))
        stop, met = (stop, met) if stop > start else (start, done)
        out.append((part, min(start * page, n), min(stop * page, n)))
        start, done = stop, met
    return out


def partition_of(vertex: Column, ranges: list[tuple[int, int, int]]) -> Column:
    """The part that a vertex lies in: an expression over the few range ends, no join."""
    out = F.lit(None).cast("int")
    for part, lo, hi in reversed(ranges):
        out = F.when((vertex >= lo) & (vertex < hi), part).otherwise(out)
    return out


def assign_partition(vertices: DataFrame, ranges: list[tuple[int, int, int]], col: str = "id") -> DataFrame:
    return vertices.withColumn("part", partition_of(F.col(col), ranges))


def owned_edges(edges: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """(src, dst, part, src_part): an edge lives with its dst."""
    return edges.select("src", "dst", partition_of(F.col("dst"), ranges).alias("part"), partition_of(F.col("src"), ranges).alias("src_part"))


def partition_edges(edges: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    return owned_edges(edges, ranges).groupBy("part", "src_part").agg(F.count("*").alias("edges"))


def mirrors(edges: DataFrame, ranges: list[tuple[int, int, int]], page: int = 4096) -> DataFrame:
    """(part, src, mirror_idx): the distinct sources that a part needs, numbered in id order.

    Numbered inside pages of ids and offset by the counts of the pages before, so no part is sorted in one task."""
    distinct = owned_edges(edges, ranges).select("part", "src").distinct().withColumn("page", F.floor(F.col("src") / page))
    sums = distinct.groupBy("part", "page").agg(F.count("*").alias("c"))
    w = Window.partitionBy("part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "page", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part", "page").orderBy("src")) - 1
    return distinct.withColumn("k", inside).join(base, ["part", "page"]).select("part", "src", (F.col("base") + F.col("k")).alias("mirror_idx"))


def mirror_presence(edges: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """(src, parts, copies): where each vertex has a mirror, and in how many parts."""
    found = owned_edges(edges, ranges).groupBy("src").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    return found.select("src", F.array_join("parts", ",").alias("parts"), F.size("parts").cast("long").alias("copies"))


def active_counts(edges: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    owned = owned_edges(edges, ranges)
    return owned.groupBy("part", "src_part").agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
