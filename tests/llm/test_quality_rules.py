import re
from collections import Counter

from hopflow.llm import quality_rules as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check(df):
    for r, g in zip(df.collect(), Q.assess(df).collect(), strict=True):
        n = brute(r["text"])
        assert (g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (r["doc_id"], *n)
        assert g["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert g["kept"] == (not g["base_failed"] and g["broken_rules"] == "")


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_verdicts_follow_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = Q.assess(df).join(labels, "doc_id").filter("n_words >= 50").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.995 * len(good)
    assert sum(r["kept"] for r in bad) < 0.1 * len(bad)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, " \t\n"), (3, "a b a b a b"), (3, "a b a b a b"), (4, "the of " * 30_000), (5, "a\n\na\n \nb\n"), (6, "é\x0bÉ # <> 𝒳"), (7, "one two three\x0cone two three")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, _words string")
    check(df)
    assert Q.assess(df.limit(0)).collect() == []
    assert all(r["kept"] == (not r["base_failed"]) for r in Q.assess(df, rules=()).collect())
