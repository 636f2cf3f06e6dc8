"""Spelling variants against plain Python over all pairs and deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hopflow.llm import spelling as S
from tests.conftest import SF

SCHEMA = "doc_id long, text string"


def counted(docs):
    n = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def expected(n):
    """word -> (form, root, n, n_near, form_n), by all deletions of every word."""
    near, same = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            same[w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def got(spark, docs):
    rows = S.variants(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_whole_table(spark):
    from hopflow.llm.queries import op12_spelling

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op12_spelling(spark, SF).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == expected(counted(docs))


def test_edits_everywhere(spark):
    """Every single edit of words of 7 to 40 letters, repeated letters and letters of two bytes among them."""
    rng = random.Random(5)
    words = ["aaaaaaa", "abababababab", "aaaaaaaaaaaaaaaaaaaaaaaaa", "éèéèéèéè", "ÿÀÖabcdefghi"]
    words += ["".join(rng.choice("abcé") for _ in range(n)) for n in (7, 8, 9, 12, 13, 14, 24, 25, 26, 40)]
    docs = []
    for w in words:
        forms = {w}
        for k in range(len(w) + 1):
            forms |= {w[:k] + c + w[k:] for c in "aé"} | {w[:k] + w[k + 1 :]} | {w[:k] + c + w[k + 1 :] for c in "bÿ"}
        docs += [(i, " ".join([f] * (60 if f == w else 3))) for i, f in enumerate(sorted(forms))]
    want = expected(counted(docs))
    assert sum(v[0] is not None for v in want.values()) > 500
    assert got(spark, docs) == want


def test_chains_lead_to_the_root(spark):
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate((("aaaaaaaaaa", 1), ("aaaaaaaaab", 11), ("aaaaaaaabb", 130), ("aaaaaaabbb", 1500), ("aaaaaabbbb", 16000), ("aaaaaabbbb", 16000)))]
    docs += [(99, "aaaaaaaaaa")]
    want = expected(counted(docs))
    assert got(spark, docs) == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_many_words_one_edit_apart(spark):
    """One segment that thousands of words share."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"tion{a}{b}{c}" for a in letters[:12] for b in letters for c in letters[:12]] + [f"{a}{b}ationen" for a in letters for b in letters]
    docs = [(k, f"{w} {w}") for k, w in enumerate(words)] + [(7, "tionaaa " * 50)]
    assert got(spark, docs) == expected(counted(docs))


def test_edge_cases(spark):
    """Null texts and ids, upper case of two bytes, repeated rows, a run as long as a text, an empty table, other columns."""
    docs = [(None, "Straßenbahn straßenbahn"), (None, "Straßenbahn straßenbahn"), (1, None), (2, ""), (3, "ÉCOLIERS éCOLIERS école"), (3, "ÉCOLIERS éCOLIERS"), (5, "×÷×÷×÷× ×÷×÷×÷×"), (6, "short words only")]
    assert got(spark, docs) == expected(counted(docs))
    assert got(spark, []) == {}
    clash = spark.createDataFrame([(1, "letters letters", "a", 1)], SCHEMA + ", word string, n int")
    assert [tuple(r) for r in S.variants(clash).collect()] == [("letters", None, "letters", 2, 0, None)]


def test_runs_as_long_as_a_text(spark):
    long = "xy" * 150_000
    docs = [(4, f"{long} {long} {long}z {long}z"), (5, f"{long[:-1]}é {long[:-1]}é"), (6, f"a{long[1:]} a{long[1:]}")]
    n = counted(docs)
    assert len(n) == 4  # none of these runs loses a letter
    near = {w: r[3] for w, r in got(spark, docs).items()}
    assert set(near) == set(n) and near[long] == 3 and near[long + "z"] == 1
