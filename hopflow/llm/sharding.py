"""Shuffled shards through a Feistel permutation of global row numbers. DataFrame functions only.

Rows are numbered 0 .. N-1 in the order (id, size, checksum). A Feistel network over Z_a x Z_b, with
a * b just above N, permutes the numbers; where it leaves the range it is applied again (cycle walking).
The permuted position p gives shard p mod S and slot p div S, so shard sizes differ by one row at most
and anyone who knows N and the seed can compute where a row went, or which row fills a slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import written

#: Modulus and multipliers of the integer mixing function; products stay below 2**61.
MODULUS = 2147483648
MULTIPLIERS = (739982445, 695872825)
ROUNDS = 6
#: Steps a walk may take. The domain exceeds N by at most sqrt(N) + 1 points, so a walk of W steps happens
#: with probability about N ** (-W / 2); a walk that is still outside raises an error.
MAX_WALK = 64


def domain(n: int) -> tuple[int, int]:
    """The sides a, b of the smallest near-square domain that holds n numbers."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[int]:
    keys, x = [], seed % MODULUS
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) % MODULUS
        keys.append(x)
    return keys


def mix(value: Column) -> Column:
    h = value % MODULUS
    h = h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(MULTIPLIERS[0]).cast("long") % MODULUS
    h = h.bitwiseXOR(F.shiftright(h, 12)) * F.lit(MULTIPLIERS[1]).cast("long") % MODULUS
    return h.bitwiseXOR(F.shiftright(h, 15))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over a number in [0, a * b)."""
    a, b = domain(n)
    long = lambda v: F.lit(v).cast("long")
    start = F.struct((x % long(a)).alias("l"), F.expr("0L").alias("r"), long(a).alias("ml"), long(b).alias("mr"))
    start = start.withField("r", F.floor(x / a).cast("long")) if n < 2**52 else start.withField("r", (x - x % long(a)) / long(a))
    end = F.aggregate(
        F.array(*[long(k) for k in round_keys(seed)]),
        start,
        lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + mix(s["r"] + k)) % s["ml"]).alias("r"), s["mr"].alias("ml"), s["ml"].alias("mr")),
    )
    # ROUNDS is even, so l is again the digit below a.
    return F.element_at(F.transform(F.array(end), lambda s: s["l"] + s["r"] * long(a)), 1)


def permute(x: Column, n: int, seed: int) -> Column:
    """The place of row number x in a pseudo-random order of n rows."""
    walk = F.element_at(
        F.transform(
            F.array(feistel(x, n, seed)),
            lambda first: F.when(first < n, first).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), first, lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, seed)))
            ),
        ),
        1,
    )
    return F.element_at(F.transform(F.array(walk), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))), 1)


def number_rows(df: DataFrame, order: list[str], partitions: int) -> tuple[DataFrame, int]:
    """df with `row_number` 0 .. N-1 in the order of the given columns, and N.

    Range partitions are sorted by themselves; the offset of each is the number of rows before it. Equal rows
    are spread by their place in the input, so a value that a third of the rows share fills many partitions."""
    keyed = df.withColumn("_spread", F.monotonically_increasing_id())
    cut = keyed.repartitionByRange(partitions, *[F.col(c).asc_nulls_first() for c in order], "_spread")
    placed = cut.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], "_spread").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.drop("_spread"), "numbered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each range partition: a number that is set above, not one that grows with a key.
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("row_number", F.col("_offset") + inside)
    return numbered.drop("_part", "_offset", "_at"), total


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20260101, id_col: str = "doc_id", text_col: str = "text", rows_per_partition: int = 2_000_000) -> DataFrame:
    """Shard and slot of every row, by the law `rows`: shard sizes differ by one at most.

    Columns: the id, size (UTF-8 bytes of the text + 1), text_crc32, law, shard, slot, grown_shard (null: this law
    moves rows when the number of shards changes), row_number, position.
    A null text has no bytes: size 1, checksum 0. Null and repeated ids are numbered like any others; rows equal in
    id, size and checksum are interchangeable. An empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # As many range partitions as rows_per_partition asks for, and a few at least.
    partitions = max(8, -(-docs.count() // rows_per_partition))
    numbered, n = number_rows(slim, ["_id", "size", "text_crc32"], partitions)
    placed = numbered.withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )
