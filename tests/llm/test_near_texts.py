import re

import numpy as np

from hopflow.llm import near_texts


def shingles(text, width=5):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1)) if w)


def groups(texts):
    """texts: (key, text). The smallest key that links of similarity 0.8 or more reach from each, by all pairs that share
    a shingle."""
    root, sets, place = {k: k for k, _ in texts}, {k: shingles(t) for k, t in texts}, {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    empty = [k for k, s in sets.items() if not s]
    pairs = {(empty[0], k) for k in empty[1:]} if empty else set()
    for k, s in sets.items():
        for x in s:
            pairs.update((o, k) for o in place.setdefault(x, []))
            place[x].append(k)
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k, _ in texts}


def similar(texts):
    return {k for k, g in groups(texts).items() if k == g}


def found(spark, texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "row long, text string, node int")
    rows = near_texts.near_groups(df.repartition(5)).collect()
    assert len(rows) == len(texts)
    return {r["row"]: r["group"] for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["doc_id"], r["text"]) for r in docs]
    assert found(spark, texts) == groups(texts)


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c " * 5000), (6, "one"), (7, "\x0b \t"), (8, "a b c d e"), (9, "a b c d e a b c d e")]
    assert found(spark, texts) == groups(texts)
    assert near_texts.near_groups(spark.createDataFrame([], "row long, text string")).collect() == []


def planted(rng, words, changes):
    out = list(words)
    for k in rng.choice(len(out), changes, replace=False):
        out[k] = f"x{rng.integers(1 << 40)}"
    return out


def test_planted_copies(spark):
    """Random texts, copies of each at falling similarity; what is linked is similar, and what is similar is linked."""
    rng = np.random.default_rng(5)
    texts, pairs = [], []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        other = planted(rng, words, max(1, int(len(words) * rng.uniform(0.002, 0.03))))
        pairs.append((2 * i, 2 * i + 1))
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).upper())]
    got, want = found(spark, texts), groups(texts)
    assert all(want[k] == got[k] for k in got if got[k] != k)
    similar_ = [(a, b) for a, b in pairs if want[a] == want[b]]
    assert len(similar_) > 250 and sum(got[a] == got[b] for a, b in similar_) >= 0.97 * len(similar_)
    at = lambda lo, hi: [(a, b) for a, b in similar_ if lo <= len(shingles(texts[a][1]) & shingles(texts[b][1])) / len(shingles(texts[a][1]) | shingles(texts[b][1])) < hi]
    close = at(0.9, 1.1)
    assert close and all(got[a] == got[b] for a, b in close)


def test_large_group(spark):
    """A third of the rows are near copies of one text, more than one block of an anchor."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [(i, " ".join(planted(rng, base, 2))) for i in range(2500)]
    texts += [(2500 + i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))) for i in range(500)]
    got = found(spark, texts)
    assert {got[i] for i in range(2500)} == {0} and all(got[i] == i for i in range(2500, 3000))
