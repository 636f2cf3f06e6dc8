import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hopflow.llm import lm_scoring as M


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows, weights):
    """Base figures by the definition, and scores with given weights."""
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    uni, pairs, ctx = Counter(), Counter(), Counter()
    for i, t in rows:
        if rest(i) not in (None, 1):
            x = tokens(t)
            uni.update(x)
            pairs.update(zip([0, *x[:-1]], x))
            ctx.update([0, *x[:-1]])
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        s = 0.0
        for a, w in zip([0, *x[:-1]], x):
            l2, l1, l0 = weights[min(ctx[a].bit_length(), M.BUCKETS - 1)]
            s += math.log10(l2 * pairs[a, w] / max(ctx[a], 1) + l1 * uni[w] / max(n, 1) + l0 / (v + 1)) if n else 0.0
        out.append((i, rest(i) == 1, len(x), sum(uni[w] > 0 for w in x), n, base, s))
    return out


def run(df, monkeypatch):
    kept = []
    learn = M.learn_weights
    monkeypatch.setattr(M, "learn_weights", lambda rows: kept.append(learn(rows)) or kept[-1])
    return [tuple(r) for r in M.score(df).collect()], kept[-1]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_whole_table(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got, weights = run(df, monkeypatch)
    same(got, brute(rows, weights))
    assert np.allclose(weights.sum(axis=1), 1)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_edge_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A b\x0ba B"), (4, "b a " * 20_000), (4, "b a"), (None, "a b c"), (6, "É é  x"), (7, "a")] * 3
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block int, kind string")
    got, weights = run(df, monkeypatch)
    same(got, brute(rows, weights))
    assert M.score(df.limit(0)).collect() == []
    alone = df.filter("doc_id is null")
    got, weights = run(alone, monkeypatch)
    same(got, brute([(None, "a b c")] * 3, weights))


def test_weights_raise_likelihood():
    rows = [(3, 40, 8, 50), (3, M.NEVER, 4, 30), (3, M.NEVER, M.NEVER, 5), (0, M.NEVER, 6, 9)]
    w = M.learn_weights(rows)
    assert w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.4

    def likelihood(w):
        p = lambda q: 0 if q == M.NEVER else 2 ** (q / M.STEPS)
        return sum(n * math.log(w[b] @ (p(q2), p(q1), 1)) for b, q2, q1, n in rows)

    flat = np.full((M.BUCKETS, 3), 1 / 3)
    flat[0] = (0, 0.5, 0.5)
    assert likelihood(w) > likelihood(flat)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_packed_runs(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    assert (M.unpack(M.pack(keys)) == keys).all()
    for top in (2, 300, 2**40):
        x = np.random.default_rng(n).integers(0, top, n)
        assert (M.unpack_counts(M.pack_counts(x)) == x).all()


def test_same_in_any_order(spark, monkeypatch):
    """Rows that come in another order and other partitions at each reading; blocks cut by bytes, not by rows alone."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(M, "BLOCK_BYTES", 4096)
    want = sorted(tuple(r) for r in M.score(df).collect())
    for other in (df.repartition(7), df.orderBy("text"), df.union(df.limit(0)).repartition(3, "lang")):
        got = sorted(tuple(r) for r in M.score(other).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_tree():
    for blocks in (20, 256, 257, 65_536, 65_537, 10**7):
        levels, fan = M.tree(blocks)
        assert fan**levels >= blocks and fan <= M.FAN and (levels == 1 or M.FAN ** (levels - 1) < blocks)
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    fine = {p: (a, b) for p, a, b in M.cuts(keys, 7**3)}
    for p, a, b in M.cuts(keys, 7**2):
        inside = sorted(v for q, v in fine.items() if q // 7 == p)
        assert inside[0][0] == a and inside[-1][1] == b
    assert list(M.cuts(keys[:0], 5)) == []


def test_levels(spark, monkeypatch):
    """Any number of levels gives the same figures, and each exchanges a bounded number of rows for a block."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    made, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: made.append(write(df, name)) or made[-1])
    exchanged = {}
    for blocks, fan in ((20, 256), (64, 8), (60, 4)):
        made.clear()
        monkeypatch.setattr(M, "LEAST_BLOCKS", blocks)
        monkeypatch.setattr(M, "FAN", fan)
        got, weights = run(df, monkeypatch)
        same(got, brute(rows, weights))
        exchanged[blocks] = [t.count() for t in made]
    for blocks, levels, fan in ((64, 2, 8), (60, 3, 4)):
        assert len(exchanged[blocks]) == 2 * levels - 1
        assert max(exchanged[blocks]) <= (3 * fan + 1) * fan**levels
