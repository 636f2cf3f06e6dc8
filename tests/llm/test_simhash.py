import numpy as np
import pytest
import xxhash

from hopflow.llm import simhash


def brute(texts):
    """texts: (doc_id, text) pairs. The fingerprint and component of each, by the definition."""
    fps = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)))
    n = len(texts)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.asarray(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i in range(n):
        r = find(i)
        least[r] = min(x for x in (least.get(r), texts[i][0]) if x is not None) if (least.get(r), texts[i][0]) != (None, None) else None
    return sorted(((texts[i][0], f"{fps[i]:016x}", least[find(i)]) for i in range(n)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "a b c " * 5000), (5, "a b c " * 5000), (None, "x y z"), (7, "one"), (8, "\x0b \t")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    assert result(df) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_as_all_pairs(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(25):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.asarray(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.link_fingerprints(df, block).collect()]

    def parts(pairs):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in pairs:
            root[find(u)] = find(v)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    signed = fps.view(np.int64)
    every = [(int(signed[i]), int(signed[j])) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert all((u ^ v) & (2**64 - 1) and ((u ^ v) & (2**64 - 1)).bit_count() <= 3 for u, v in links)
    assert parts(links) == parts(every)


@pytest.mark.parametrize("code", [simhash.HALVES, simhash.Code(4, 11), simhash.Code(3, 5)])
def test_anchor_code_covers(code):
    rng = np.random.default_rng(3)
    of = lambda x: simhash.Code.anchors(code, np.asarray([x], np.uint32))[1].tolist()
    words = None
    if code.width < 16:
        every = np.arange(1 << code.width, dtype=np.uint32)
        words = [int(x) for x in every if (int(x) & of(x)[0]) == int(x) == of(x)[0]]
    for x in rng.integers(0, 2**code.width, 50, dtype=np.uint64).astype(np.uint32):
        mine = of(x)
        assert len(mine) == len(set(mine))
        assert any((int(x) ^ a).bit_count() <= 1 for a in mine) and all((int(x) ^ a).bit_count() <= 2 for a in mine)
        if words is not None:
            assert set(mine) == {w for w in words if (w ^ int(x)).bit_count() <= 2}
        for k in range(code.width):
            assert set(mine) & set(of(x ^ np.uint32(1 << k)))
