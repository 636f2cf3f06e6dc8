import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hopflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id string")


def check(rows, texts):
    """Every id of every document once, sequences gapless and within the size; returns the share of padding."""
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.SIZE
        padding += packing.pad(at)
        total += at
    return padding / max(total, 1)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert check(packing.pack_documents(df, PATH).collect(), texts) < 0.01


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|> A <|STARTOFTEXT|> b", 5: "Ünï code\x0bÉ’s 12 . ?!", 6: "x" * 5000, None: "no id"}
    rows = packing.pack_documents(docs(spark, [(k, v, 1, "s") for k, v in texts.items()]), PATH).collect()
    assert check(rows, texts) < 0.05
    assert packing.pack_documents(docs(spark, []), PATH).collect() == []


def brute(at, penalty, size):
    pos, f = [0, *at], [0]
    for j in range(1, len(pos)):
        last = j == len(pos) - 1
        cost = [f[i] + (packing.tail_cost(pos[j] - pos[i], size) if last else size - pos[j] + pos[i]) for i in range(j) if pos[j] - pos[i] <= size]
        f.append(min(cost) + penalty[j - 1])
    return f[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(1, 20, 60)).tolist()
    penalty = rng.integers(0, 10, 60).tolist()
    cuts = packing.best_cuts(at, penalty, last=True, size=64)
    cost, before = 0, 0
    for c in cuts:
        n = c - before
        assert n <= 64
        cost += penalty[at.index(c)] + (packing.tail_cost(n, 64) if c == at[-1] else 64 - n)
        before = c
    assert before == at[-1] and cost == brute(at, penalty, 64)


def test_stretches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 6000)
    vocabulary = open(PATH, encoding="utf-8").read()
    s, seen = packing.Stretch(), []
    for k in range(30):
        s.add(k, np.arange(k * 100 + 1, dtype="<u4"), np.zeros(60000, bool))
        if s.tokens > 6000:
            seen += list(s.pack(last=False))
    seen += list(s.pack(last=True))
    assert vocabulary
    got = {}
    for pieces in seen:
        assert sum(len(p[2]) for p in pieces) <= packing.SIZE
        for d, start, ids, n in pieces:
            assert start == len(got.get(d, [])) and n == d * 100 + 1
            got.setdefault(d, []).extend(ids.tolist())
    assert got == {k: list(range(k * 100 + 1)) for k in range(30)}


ODD = [None, b"", b" ", b"a", b"it's they're 'S x's 'll-'tis don't, o'clock", b"<|endoftext|> A.b <|STARTOFTEXT|> foo<|endoftext|>.. B<| c|>", "É’s Ünï\u00a0code wide\u2003nb e\u0301 ﬁ ß. straße!!! İI ΑΣ. Σ ÿ÷ÿ ö×".encode(), b'12 3a a3 a.b a..b ...a "quoted," (par) [x] {y}~ z^_` a+b=c', b"\x0b\x0c\r\n\tA\x00B\x1cC", b"x" * 5000, b"word " * 3000]


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
@pytest.mark.parametrize("chunk", [1, 1000, 1 << 23])
def test_ids_are_those_of_the_tokenizer(monkeypatch, kind, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    t, vocabulary = Tokenizer.from_file(PATH), open(PATH, encoding="utf-8").read()
    want = [[*t.encode((x or b"").decode(), add_special_tokens=False).ids, packing.END_ID] for x in ODD]
    assert [x.tolist() for x in packing.encode(pa.array([b"-", *ODD], kind).slice(1), vocabulary)] == want
    broken = b"bad \xff\xfe utf8 \xc3( caf\xc3 X\xe2\x82."
    [ids] = packing.encode(pa.array([broken], kind), vocabulary)
    assert ids.tolist() == [*t.encode(broken.decode("utf-8", "replace"), add_special_tokens=False).ids, packing.END_ID]


def test_a_word_is_tokenized_once_whatever_follows_it(monkeypatch):
    vocabulary = open(PATH, encoding="utf-8").read()
    words = [a + b + c for a in ("ba", "no", "té") for b in ("ri", "lu", "ßa") for c in ("ma", "k", "o")]
    texts = [" ".join(w + mark for w in words) for mark in ("", ".", ",", "?!", '"', ")", "%%%")] * 3
    asked = {"_plain_ids": [], "_other_ids": []}
    for name, seen in asked.items():
        tokenize = getattr(packing, name)
        monkeypatch.setattr(packing, name, lambda parts, known, tokenize=tokenize, seen=seen: seen.extend(parts) or tokenize(parts, known))
    monkeypatch.setattr(packing, "_words", {})
    monkeypatch.setattr(packing, "CHUNK", 500)
    ids = list(packing.encode(pa.array([x.encode() for x in texts], pa.binary()), vocabulary))
    t = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in ids] == [[*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for x in texts]
    assert sorted(asked["_plain_ids"]) == sorted(w.encode() for w in words)
    assert sorted(asked["_other_ids"]) == sorted([b".", b",", b"?!", b'"', b")", b"%%%"])
