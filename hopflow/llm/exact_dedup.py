"""Exact deduplication by distributed most-significant-digit radix partitioning.

A document is the byte string: its length in 8 hex digits, then its normalised text. Each level splits the groups that
the bytes before have made by their next bytes: the first by the length and FIRST bytes, the next by WIDTHS. A group is
done when it has one row or its bytes have ended; only the others go on, with only the bytes not yet read. Equality is
decided by the bytes themselves, no digest is involved.

Rows are counted on the map side. A group with a good share of all rows (copies, or texts that open alike) is dealt over
many tasks by a salt when rows are joined with the counts of their group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import ascii_lower, hot_keys, salted_join, written

#: Bytes that the levels split by: the first behind the length, then widths that grow by 32, so that a text of L bytes takes
#: some log L levels, and what is written of it is L for each; the last repeats.
FIRST, WIDTHS = 56, (1 << 11, 1 << 16, 1 << 21, 1 << 26)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id of a group stays, and among
    rows that repeat an id and text exactly one. A null text counts as empty, a null id as smaller than any other.
    An empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.lpad(F.hex(F.octet_length(text)), 8, "0").cast("binary")
    first = F.concat(length, F.substring(ascii_lower(F.substring(text, 1, FIRST)).cast("binary"), 1, FIRST))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), first.alias("digit"), F.monotonically_increasing_id().alias("rid"))
    counts = written(docs.select(first.alias("digit")).groupBy("digit").agg(F.count("*").alias("n")), "digits")
    shared = counts.filter("n > 1").select("digit", F.col("digit").alias("path"))
    level = salted_join(source, shared, ["digit"], hot_keys(counts, ["digit"], "n"), F.xxhash64("rid"), "left").withColumn("bytes", ascii_lower(F.col("text")).cast("binary"))
    rest = F.when(F.col("path").isNotNull(), F.expr(f"substring(bytes, {FIRST + 1})"))
    level = level.select("id", "rid", F.unhex(F.sha2("bytes", 256)).alias("sha"), F.col("path"), rest.alias("rest"), F.struct("id", "rid").alias("keep"), F.lit(1).cast("long").alias("n"))
    level, done, k = written(level, "radix0"), [], 0
    while True:
        done.append(level.filter("path is null"))
        active = level.filter("path is not null").select("id", "rid", "sha", "path", "rest")
        if active.isEmpty():
            break
        level = written(_split(active, WIDTHS[min(k, len(WIDTHS) - 1)]), f"radix{k + 1}")
        k += 1
    out = done[0].select("id", "rid", "sha", "keep", "n")
    for part in done[1:]:
        out = out.unionByName(part.select("id", "rid", "sha", "keep", "n"))
    return out.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _split(active: DataFrame, width: int) -> DataFrame:
    """One level: rows of finished groups get a null path, the others a new path and the bytes that are left."""
    cut = active.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
    groups = written(cut.groupBy("path", "digit").agg(F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("keep")), "groups")
    both = salted_join(cut, groups, ["path", "digit"], hot_keys(groups, ["path", "digit"], "n"), F.xxhash64("rid"))
    over = (F.col("n") == 1) | (F.octet_length("rest") <= width)
    return both.select(
        "id", "rid", "sha",
        F.when(~over, F.col("keep.rid").cast("string").cast("binary")).alias("path"),
        F.when(~over, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        "keep", "n",
    )
