"""Running sums and ranks over all rows without one task that meets them all.

Rows are handled inside pages of ids; pages are offset by the sums of the pages before, in books of pages. What meets
in one task is a page, a book, or one row for each book: with BOOK = PAGE = 4096, one row for 16 million ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopflow.sources.scratch import written

PAGE = BOOK = 4096


def _before(value: str | Column, keys: list[str], order: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def running(rows: DataFrame, value: str, out: str, keys: list[str] | None = None, page: int = PAGE) -> DataFrame:
    """rows (id, value, keys...) with `out`: the sum of the values of smaller ids among the rows with equal keys.

    Ids are distinct within a key; keys are not null."""
    keys = keys or []
    paged = rows.withColumn("_page", F.floor(F.col("id") / page)).withColumn("_book", F.floor(F.col("_page") / BOOK))
    pages = paged.groupBy(*keys, "_book", "_page").agg(F.sum(value).alias("_s"))
    books = pages.groupBy(*keys, "_book").agg(F.sum("_s").alias("_s"))
    # The one window that is not cut: one row for each book.
    base = books.withColumn("_base", _before("_s", keys, "_book")).drop("_s")
    pages = pages.withColumn("_in_book", _before("_s", [*keys, "_book"], "_page")).drop("_s")
    inside = paged.withColumn("_in_page", _before(value, [*keys, "_page"], "id"))
    both = inside.join(pages, [*keys, "_book", "_page"]).join(base, [*keys, "_book"])
    return both.withColumn(out, F.col("_base") + F.col("_in_book") + F.col("_in_page")).drop("_page", "_book", "_base", "_in_book", "_in_page")


def in_order(rows: DataFrame, order: list[Column], name: str, keys: list[str] | None = None, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows with their 0-based place `name` in this order among the rows with equal keys (columns without nulls).

    Rows are dealt over ranges of (keys, order), sorted there and written with the number of their task and their place
    in it; places are offset by the counts of the tasks before, one row for each task and key. Rows that are equal in
    keys and order meet in one task, so `order` must tell most rows apart. `write` makes and reads back a table."""
    keys = keys or []
    by = [*[F.col(k) for k in keys], *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = write(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33).cast("int")), "in_order")
    counts = placed.groupBy(*keys, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*keys, "_task", (before - F.col("_first")).alias("_base"))
    return placed.join(base, [*keys, "_task"]).withColumn(name, F.col("_base") + F.col("_at")).drop("_at", "_task", "_base")


#: Bins of values in each octave. A long falls into one of 63 * OCTAVE bins of its sign.
OCTAVE = 256


def bin_of(value: Column) -> Column:
    """A bin in logarithmic steps that never falls where the value rises."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value.cast("double")) + 1) * OCTAVE)).cast("int")


def top(rows: DataFrame, value: str, size: Column, keys: list[str] | None = None) -> DataFrame:
    """rows (id, value, keys...) with `slot`, their place by value, largest first, ties by id, among the rows with equal
    keys; the first `size` of each, an expression over the keys and `_all`, their number of rows.

    A histogram in logarithmic bins, at most 126 * OCTAVE rows for each key, tells the bin in which a top ends; rows of
    lower bins are left out, the others are sorted by ranges and numbered. Nothing else is in one window."""
    keys = keys or []
    binned = written(rows.withColumn("_bin", bin_of(F.col(value))), "binned")
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    larger = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_larger", F.coalesce(F.sum("_n").over(larger), F.lit(0)))
    reach = counts.withColumn("_size", size).filter("_larger < _size").select(*keys, "_bin", "_size")
    placed = in_order(binned.join(reach, [*keys, "_bin"]), [F.desc(value), F.col("id")], "slot", keys)
    return placed.withColumn("slot", F.col("slot").cast("long")).filter(F.col("slot") < F.col("_size")).drop("_bin", "_size")
