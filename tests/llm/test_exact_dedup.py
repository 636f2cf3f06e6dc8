import hashlib
import re

from pyspark.sql import functions as F

from hopflow.llm import exact_dedup as E


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        real = [x for x in ids if x is not None]
        out.append((i, max(real) if real else None, len(ids), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str), {k: (max([x for x in v if x is not None], default=None)) for k, v in groups.items()}


def check(df, rows):
    got = E.exact_dedup(df).collect()
    want, best = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    stay = [r for r in got if r["kept"]]
    assert sorted((r["text_sha256"], r["doc_id"]) for r in stay if r["doc_id"] is not None) == sorted((hashlib.sha256(k.encode()).hexdigest(), v) for k, v in best.items() if v is not None)
    assert len(stay) == len(best)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_edge_cases(spark):
    long = "Ab é" * 30_000
    rows = [(1, None), (2, ""), (3, "A"), (4, "a"), (4, "a"), (None, "a"), (None, "b"), (None, "B"), (5, "É"), (6, "é"), (7, long), (8, long.upper().replace("É", "é")), (9, long + "x"), (10, long[:-1]), (11, "é" * 40 + "1"), (12, "é" * 40 + "2"), (13, "x" * 56), (14, "X" * 56)]
    df = spark.createDataFrame([(*r, "p", 1, 1) for r in rows], "doc_id long, text string, path string, id int, digit int")
    check(df, rows)
    assert E.exact_dedup(df.limit(0)).collect() == []
    assert E.exact_dedup(df.limit(1)).count() == 1


def test_long_copies_take_few_tables(spark, monkeypatch):
    """Two equal texts of 16 MB, and one that differs in its last letter."""
    names, plain = [], E.written
    monkeypatch.setattr(E, "written", lambda df, name: names.append(name) or plain(df, name))
    line = F.repeat(F.lit("Some words of a long line. "), 600_000)
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(line, F.when(F.col("id") == 2, "x").otherwise("y")).alias("text")).repartition(3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(df).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True)}
    assert len(names) < 20
