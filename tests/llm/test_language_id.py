import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from hopflow.llm import language_id as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def model():
    pieces = ["a", "ab", "b", "ba", "bab", L.SPACE, L.SPACE + "a", L.SPACE + "ab"]
    p = np.random.default_rng(1).random((len(pieces) + 1, 3))
    return L.Model(pieces, ["x", "y", "z"], p / p.sum(axis=0), np.zeros(3))


def brute(m, word, l):
    """Probability of a word, and expected uses of each piece, over all segmentations."""
    s = L.SPACE + word
    total, uses = 0.0, np.zeros(len(m.p))
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(s[at:k])
                at = k
        ids = [m.pieces.index(x) if x in m.pieces else len(m.pieces) if len(x) == 1 else None for x in parts]
        if None not in ids:
            q = math.prod(m.p[i, l] for i in ids)
            total += q
            for i in ids:
                uses[i] += q
    return total, uses / total


@pytest.mark.parametrize("word", ["a", "ab", "babab", "abcab", "çab"])
def test_forward_sums_all_segmentations(word):
    m = model()
    r = L.Reader(m)
    for l in range(3):
        p, uses = brute(m, word, l)
        assert math.isclose(math.exp(r.word_scores([word, "b", word])[2][l]), p)
        got = np.zeros(len(m.p))
        for k, x in r.expected(word, l):
            got[k] += x
        assert np.allclose(got, uses)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    rows = L.identify(df, PATH).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_edge_cases(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 _ ² ½ !", "en"),
            (None, "the dog", "en"), (7, "the " * 50_000, None), (7, "x" * 1000, None), (8, "日本語" * 30, None)]
    df = spark.createDataFrame([(*r, 1.0, "a") for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    got = [tuple(r) for r in L.identify(df, PATH).collect()]
    assert [g[0] for g in got] == [r[0] for r in rows]
    assert [g[2] for g in got][2:5] == ["und"] * 3 and got[6][2] == "en" and got[7][2] in ("en", "fr") and got[8][2] in ("en", "fr")
    assert L.identify(df.limit(0), PATH).collect() == []
    assert [r["lang_pred"] for r in L.identify(df.filter("lang is null"), PATH).collect()] == ["und"] * 3


def test_hot_text_takes_one_place_of_the_sample(spark):
    """A text with more copies than the sample has room for leaves the room to the others, and counts in the prior."""
    rows = [("x", "gleich")] * 50 + [("x", f"wort{c}") for c in "abcdefgh"] + [("y", "other")] * 8
    m = L.fit(spark.createDataFrame(rows, "lang string, text string"), PATH, sample=9)
    once = L.fit(spark.createDataFrame(sorted(set(rows)), "lang string, text string"), PATH, sample=9)
    assert m.languages == ["x", "y"] and np.allclose(m.p, once.p)
    assert np.allclose(np.exp(m.prior), [58 / 66, 8 / 66])
