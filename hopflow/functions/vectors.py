"""Vectors as array<double> columns and their element-wise sums, which are added up on the map side: as generated columns
where vectors are narrow, in Arrow batches where they are wide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of up to this width are summed by one generated aggregate for each dimension.
NARROW = 128
#: Bytes of partial sums that a task holds before it sends them on.
HELD = 64 << 20


def weighted_sum(rows: DataFrame, keys: list[str], vector: str, width: int, weight: Column | None = None, out: str = "x", narrow: int = NARROW) -> DataFrame:
    """For each key the sum of weight * vector; no list of vectors is ever gathered, not even of a hub.

    Rows with a null key are left out; null weights and null elements add nothing. Wider vectors than `narrow` go through
    Arrow: their keys must be whole numbers, and a vector of another width is an error."""
    rows = rows.dropna(subset=keys)
    if width > narrow:
        return _wide_sum(rows, keys, vector, width, weight, out)
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(F.get(vector, F.lit(i)) * w).alias(f"_{i}") for i in range(width)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_{i}") for i in range(width)]).alias(out))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of a matrix, without a loop; null elements are 0."""
    flat = column.flatten()
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors of {width} numbers are expected")
    return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(x: np.ndarray, whole: bool = False) -> pa.ListArray:
    """Rows of a matrix as an Arrow column of lists of doubles, or of longs."""
    kind = pa.int64() if whole else pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _combined(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal keys added up; keys in order."""
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[starts], np.add.reduceat(x[order], starts, axis=0)


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first n columns, whole numbers, as a matrix."""
    return np.stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(n)], axis=1)


def _batches_of(found: np.ndarray, x: np.ndarray, types: list[pa.DataType], names: list[str], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Keys of these types and their vectors in Arrow batches of 16 MB."""
    step = max(1, (16 << 20) // (x.shape[1] * 8))
    for at in range(0, len(found), step):
        part = [pa.array(np.ascontiguousarray(found[at : at + step, k]), pa.int64()).cast(types[k]) for k in range(len(types))]
        yield pa.RecordBatch.from_arrays([*part, lists(x[at : at + step], whole)], names=names)


def _wide_sum(rows: DataFrame, keys: list[str], vector: str, width: int, weight: Column | None, out: str) -> DataFrame:
    """Partial sums of a task's rows, at most HELD bytes at a time, dealt by key, sorted, and added up as they come."""
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<double>"

    weighted = weight is not None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, types = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, types = matrix(batch.column(len(keys)), width), [c.type for c in batch.columns[: len(keys)]]
            if weighted:
                x = x * pc.fill_null(batch.column(len(keys) + 1), 0.0).to_numpy(zero_copy_only=False)[:, None]
            held.append(_combined(_columns(batch, len(keys)), x))
            size += held[-1][1].nbytes
            if size > HELD:
                held = [_combined(*map(np.concatenate, zip(*held)))]
                size = held[0][1].nbytes
                if size > HELD // 2:  # they are different keys for the most part
                    yield from _batches_of(*held.pop(), types, [*keys, out])
                    size = 0
        if held:
            yield from _batches_of(*_combined(*map(np.concatenate, zip(*held))), types, [*keys, out])

    slim = rows.select(*keys, F.col(vector).cast("array<double>"), *([] if weight is None else [weight.cast("double").alias("_weight")]))
    partials = slim.mapInArrow(partial, schema)
    return merged_sum(partials, keys, out, width)


def merged_sum(partials: DataFrame, keys: list[str], out: str, width: int) -> DataFrame:
    """Vectors of doubles or longs added up by key: dealt by key, sorted, and added up as they come."""
    whole = partials.schema[out].dataType.elementType.simpleString() == "bigint"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next one."""
        waiting, types = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            found, x, types = _columns(batch, len(keys)), matrix(batch.column(len(keys)), width), [c.type for c in batch.columns[: len(keys)]]
            if waiting is not None:
                found, x = np.concatenate([waiting[0], found]), np.concatenate([waiting[1], x])
            found, x = _combined(found, x)
            waiting = found[-1:], x[-1:]
            yield from _batches_of(found[:-1], x[:-1], types, [*keys, out], whole)
        if waiting is not None:
            yield from _batches_of(*waiting, types, [*keys, out], whole)

    slim = partials.select(*keys, out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def applied(rows: DataFrame, function: Callable, inputs: list[str], name: str, kind: str = "array<double>") -> DataFrame:
    """rows with column `name` of type `kind`: what a numpy function makes of the columns `inputs`, a batch of rows at a time.

    Vectors come as matrices with a row for each row, numbers as arrays; a matrix or an array with as many rows comes
    back. Vectors of a batch must have one width and no nulls."""
    kept = [c for c in rows.columns if c != name]
    places = [rows.columns.index(c) for c in kept]
    at, schema = [rows.columns.index(c) for c in inputs], ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + f", `{name}` {kind}"

    def argument(column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            return matrix(column, len(column[0]) if len(column) else 0)
        return column.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            result = np.asarray(function(*[argument(batch.column(k)) for k in at]))
            if len(result) != batch.num_rows:
                raise ValueError(f"{len(result)} results for {batch.num_rows} rows")
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], lists(result) if result.ndim == 2 else pa.array(result)], names=[*kept, name])

    return rows.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times_matrix(x: Column, w: list[list[float]]) -> Column:
    """x W for a small matrix with as many rows as x has elements; a projection, W is part of the plan."""
    return F.array(*[dot(x, F.array(*[F.lit(float(row[j])) for row in w])) for j in range(len(w[0]))])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(x: Column, slope: float) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v).otherwise(v * slope))


def log_softmax(x: Column) -> Column:
    """Row-wise and shifted by the maximum, so that large scores do not overflow."""
    top = F.array_max(x)
    shifted = F.transform(F.array(top), lambda t: F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - t))) + t)
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(shifted[0], F.size(x)).alias("z")), lambda p: p["v"] - p["z"])


def argmax(x: Column) -> Column:
    """0-based, the first on ties."""
    return F.array_position(x, F.array_max(x)) - 1


def exploded(df: DataFrame, keys: list[str], vector: str, digits: int = 6) -> DataFrame:
    """One row (keys, pos, value) for each element."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.round("value", digits) + F.lit(0.0))
