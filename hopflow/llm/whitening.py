"""Whitening of embeddings by Chan's merging of moments.

Each partition gives the number of its vectors, their sums, and the scatter around their own mean; two partials merge by
Chan's formula, in a tree. The driver decomposes the covariance, whose size is that of a vector squared whatever the rows.
A second pass takes the moments of the whitened vectors in the same way and shows how far their covariance is from the
identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT, cut to LIMIT in size, which only entries of over 2**30 reach.
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 40


@dataclass
class Moments:
    """Of n vectors: sums (exact for integer vectors) and scatter, the sum of (x - mean)(x - mean)^T."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        n = len(x)
        sums = np.asarray(x.sum(axis=0).tolist(), object if x.dtype.kind == "i" else float)
        centred = x - (sums / n).astype(float)
        return Moments(n, sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula for the union of two sets."""
        n = self.n + other.n
        apart = (other.sums / other.n - self.sums / self.n).astype(float)
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """None stands for no vectors."""
    return a if b is None else b if a is None else a.merged(b)


@dataclass
class Model:
    """Of n vectors of x: sums, eigenvectors as columns by falling eigenvalue, the eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - (self.sums / self.n).astype(float)) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums of (n * x - S)^2; in numbers of any length where 64 bits might not hold them."""
        far = max(int(x.max()), -int(x.min())) if x.size else 0
        reach = self.n * far + max(abs(s) for s in self.sums)
        kind = np.int64 if reach * reach * x.shape[1] < 1 << 63 else object
        off = self.n * x.astype(kind) - self.sums.astype(kind)
        return (off * off).sum(axis=1).tolist()


def quantised(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): which rows of a column hold `width` finite entries, and their integer vectors."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
    whole = np.isfinite(c).all(axis=1)
    return at[whole], np.clip(np.floor(c[whole] * SCALE) + SHIFT, -LIMIT, LIMIT).astype(np.int64)


def width_of(rows: DataFrame, vector_col: str) -> int | None:
    """The most frequent length of the vectors; the larger one on ties."""
    size = F.size(vector_col)
    lengths = rows.filter(F.col(vector_col).isNotNull() & (size > 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    best = lengths.agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
    return best["size"] if best else None


def moments(rows: DataFrame, vector_col: str, width: int, model: Model | None = None) -> Moments | None:
    """The moments of the integer vectors of all rows, or of what a model whitens them to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = quantised(batch.column(0), width)[1]
            if len(x):
                total = merge(total, Moments.of(x if model is None else model.whitened(x)))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["m"])

    partials = rows.select(vector_col).mapInArrow(run, "m binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    # A partition without vectors gives no partial, and a tree without any cannot be reduced.
    none = rows.sparkSession.sparkContext.parallelize([None], 1)
    return partials.union(none).treeReduce(merge)


def fit(rows: DataFrame, vector_col: str, width: int, components: int) -> Model | None:
    found = moments(rows, vector_col, width)
    if found is None:
        return None
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * width * np.finfo(float).eps).sum())
    return Model(found.n, found.sums, vectors[:, :kept], values[:kept], float(np.trace(found.scatter / found.n)))


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Of each vector and component a row (id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries have no rows; nor have those whose length is not the most
    frequent one (ties: the larger), since they have no place in a covariance. An entry c, as a double, becomes
    x = floor(1024 * c) + 100000, cut to 2**40 in size. The fit takes all vectors, whose number is n. deviation is exact:
    the sum over dimensions of (n * x - sum of x)^2. Components without variance cannot be whitened and have no rows, so
    equal vectors alone give none. Null and repeated ids and repeated vectors are rows like any others; an empty table
    gives no rows; other columns are ignored."""
    kind = rows.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, {SCHEMA}"
    width = width_of(rows, vector_col)
    model = fit(rows, vector_col, width, components) if width else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    checked = moments(rows, vector_col, width, model)
    k = len(model.values)
    error = float(np.abs(checked.scatter / checked.n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = quantised(batch.column(1), width)
            if not len(at):
                continue
            m = len(at)
            exact = pa.array(model.deviations(x), pa.decimal128(38, 0)) if m else None
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n)), exact.take(each), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(id_col, vector_col).mapInArrow(run, schema)
