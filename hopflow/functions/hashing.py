"""A seeded integer hash in plain bigint arithmetic: the same value in Spark and in any SQL engine.

Choices that must be reproducible under any partitioning, such as shuffles and neighbour samples, are made by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus, start, multipliers. Products stay below 2**61.
M, START, A, B = 2147483648, 42, 739982445, 695872825


def _mixed(h: Column) -> Column:
    h = h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(A).cast("long") % M
    h = h.bitwiseXOR(F.shiftright(h, 12)) * F.lit(B).cast("long") % M
    return h.bitwiseXOR(F.shiftright(h, 15))


def hash_of(*parts: Column | int) -> Column:
    """The hash, in 0 .. M - 1, of non-negative long parts in order; folded part by part, so the expression stays small."""
    columns = [(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts]
    return F.aggregate(F.array(*columns), F.lit(START).cast("long"), lambda h, p: _mixed((h + p % M) % M))


def continued(h: Column, part: Column) -> Column:
    """The hash of some parts and one more, by the hash h of those."""
    return F.aggregate(F.array(part.cast("long")), h, lambda h, p: _mixed((h + p % M) % M))


def with_hash(df: DataFrame, name: str, *parts: Column | int) -> DataFrame:
    """df with the hash in column `name`: the same value in plain arithmetic, one projection for each step, so that it is
    compiled. For rows by the million; hash_of is an expression and fits anywhere."""
    h: Column = F.lit(START).cast("long")
    for p in parts:
        part = (F.lit(p) if isinstance(p, int) else p).cast("long")
        df = df.withColumn(name, (h + part % M) % M)
        h = F.col(name)
        df = df.withColumn(name, h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(A).cast("long") % M)
        df = df.withColumn(name, h.bitwiseXOR(F.shiftright(h, 12)) * F.lit(B).cast("long") % M)
        df = df.withColumn(name, h.bitwiseXOR(F.shiftright(h, 15)))
    return df


def hash_sql(*parts: str | int) -> str:
    """The same as DuckDB SQL."""
    h = f"((h + x % {M}) % {M})"
    h = f"(xor({h}, {h} >> 15) * {A} % {M})"
    h = f"(xor({h}, {h} >> 12) * {B} % {M})"
    h = f"xor({h}, {h} >> 15)"
    items = ", ".join(f"CAST({p} AS BIGINT)" for p in (START, *parts))
    return f"list_reduce([{items}], lambda h, x: {h})"


def hash_py(*parts: int) -> int:
    """The same for plain numbers."""

    def step(h: int, p: int) -> int:
        h = (h + p % M) % M
        h = (h ^ h >> 15) * A % M
        h = (h ^ h >> 12) * B % M
        return h ^ h >> 15

    return reduce(step, parts, START)
