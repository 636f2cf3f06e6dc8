"""Whitening against numpy on whole tables, exact deviations, hostile vectors."""

import math

import numpy as np
import pytest

from hopflow.llm import whitening as W
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, components=8):
    """(model parts) by exact integers and one covariance of all rows at once."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.asarray([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    return kept, n, deviation, white, values[:components] / values.sum()


def compare(rows, result):
    kept, n, deviation, white, explained = expected(rows)
    by = {}
    for r in result:
        by.setdefault((r["vec_id"], int(r["deviation"])), []).append(r)
    assert len(result) == len(kept) * white.shape[1]
    flip = None
    for (ident, _), d, w in zip(kept, deviation, white, strict=True):
        mine = sorted(by[ident, d], key=lambda r: r["component"])[: white.shape[1]]
        assert [r["component"] for r in mine] == list(range(1, white.shape[1] + 1)) and {r["n"] for r in mine} == {n}
        got = np.asarray([r["whitened"] for r in mine])
        flip = np.sign(got * w) if flip is None else flip
        assert np.allclose(got * flip, w, rtol=1e-7, atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in result}) == 1 and result[0]["identity_error"] < 1e-9


def test_whole_table(spark):
    from hopflow.llm.queries import op13_whitening

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(rows, op13_whitening(spark, SF).collect())


def _vectors(n, width=10, seed=3):
    rng = np.random.default_rng(seed)
    return [(k, [float(np.float32(c)) for c in rng.normal(size=width) * np.linspace(1, 3, width)]) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_any_partitioning(spark, parts):
    rows = _vectors(120)
    compare(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())


def test_merging_equals_one_pass():
    x = np.random.default_rng(1).integers(99_000, 101_000, (500, 6))
    whole, total = W.Moments.of(x), None
    for part in np.split(x, [1, 2, 90, 91, 400]):
        total = W.merge(total, W.Moments.of(part))
    assert total.n == whole.n and list(total.sums) == list(whole.sums) and np.allclose(total.scatter, whole.scatter, rtol=1e-12)


def test_hostile_vectors(spark):
    """Null vectors, entries, ids; not finite; of another length; empty; repeated ids and rows."""
    rows = [*_vectors(60), *_vectors(5), (None, _vectors(1, seed=8)[0][1])]
    bad = [(1, None), (2, []), (3, [1.0] * 9 + [None]), (4, [1.0] * 9 + [float("nan")]), (5, [float("inf")] + [0.0] * 9), (6, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 AS component", "'x' AS deviation", "2 AS n")
    out = W.whiten(df).collect()
    kept, n, deviation, *_ = expected(rows)
    assert len(out) == len(kept) * 8 and out[0]["n"] == n
    assert sorted({int(r["deviation"]) for r in out}) == sorted(set(deviation))


def test_exact_beyond_64_bits(spark):
    rows = [(k, [v * (1 + k % 7) * 1e6 for v in vec]) for k, vec in _vectors(30)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    compare(rows, W.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    huge = W.whiten(spark.createDataFrame([*rows, (9, [3e38] * 10)], SCHEMA)).collect()
    assert all(r["deviation"] is not None and math.isfinite(r["whitened"]) for r in huge)


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        out = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = W.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], SCHEMA)).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1.0)
