import zlib
from collections import Counter

import pytest

from hopflow.llm import sharding as S

SEED = 20260101


def mix(h):
    h %= S.MODULUS
    h = (h ^ h >> 15) * S.MULTIPLIERS[0] % S.MODULUS
    h = (h ^ h >> 12) * S.MULTIPLIERS[1] % S.MODULUS
    return h ^ h >> 15


def place(x, n, seed=SEED):
    a, b = S.domain(n)
    while True:
        l, r, ml, mr = x % a, x // a, a, b
        for k in S.round_keys(seed):
            l, r, ml, mr = r, (l + mix(r + k)) % ml, mr, ml
        x = l + r * a
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_walk_is_a_permutation(n):
    a, b = S.domain(n)
    assert n <= a * b <= n + a
    assert sorted(place(x, n) for x in range(n)) == list(range(n))


def check(rows, got, shards=16):
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    by_number = {r["row_number"]: r for r in got}
    assert sorted(by_number) == list(range(len(rows)))
    for k, (i, t) in enumerate(want):
        r = by_number[k]
        raw = (t or "").encode()
        p = place(k, len(rows))
        assert (r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) == (i, len(raw) + 1, zlib.crc32(raw), "rows", p % shards, p // shards, None)
    sizes = Counter(r["shard"] for r in got)
    assert not rows or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in df.collect()], S.assign_shards(df).collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "é"), (None, "é"), (3, "x" * 100_000)] + [(7, "same")] * 40
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, size int, shard int")
    check(rows, S.assign_shards(df).collect())
    check([], S.assign_shards(df.limit(0)).collect())
