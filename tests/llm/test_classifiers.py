import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hopflow.llm import evidence, mixing, quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_quality_follows_labels_and_sites(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.99 * len(good) and sum(r["kept"] for r in bad) < 0.25 * len(bad)
    for r in rows:
        prior = min(max(r["path_share"], Q.EDGE), 1 - Q.EDGE)
        assert math.isclose(r["quality_score"], 1 / (1 + math.exp(-r["evidence"]) * (1 - prior) / prior), rel_tol=1e-9)


def test_sparse_sites_shrink(spark):
    good, bad = "the cat and the dog of it " * 12, "x%%% y*** z### w$$$ " * 12
    rows = [(i, good if i % 4 else bad, "big", "a") for i in range(400)] + [(1000, bad, "tiny", "a"), (1001, bad, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    share = {r["doc_id"]: r["path_share"] for r in Q.classify(docs, labels).collect()}
    assert 0.6 < share[1] < 0.85 and share[1000] > 0.2 and share[1001] > 0.2


def plain_projected_gradient(tokens, p, goal, steps=200_000):
    """The least squared miss over a domain's tokens, by plain projected gradient on all rates with small steps."""
    r, have = np.ones(len(tokens)), tokens @ p
    for _ in range(steps):
        miss = (tokens * r) @ p - goal
        moved = np.clip(r - p @ (miss / have), 0, 1)
        if np.abs(moved - r).max() < 1e-10:
            break
        r = moved
    return (tokens * r) @ p


def test_mixture_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).collect()
    have = {d: sum(r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    got = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    goal = {d: mixing.TARGETS[d] * have["clean"] * (1 - mixing.SPARE) / mixing.TARGETS["clean"] for d in mixing.DOMAINS}
    assert all(0 <= r["rate"] <= 1 for r in rows)
    for d in mixing.DOMAINS:
        assert math.isclose(rows[0][f"goal_{d}"], goal[d], rel_tol=1e-6) and math.isclose(rows[0][f"reached_{d}"], got[d], rel_tol=1e-6)
        assert have[d] < goal[d] or abs(got[d] - goal[d]) < 0.0001 * goal[d], d
    tokens, p = np.asarray([r["n_tokens"] for r in rows], float), np.asarray([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    want = plain_projected_gradient(tokens, p, np.asarray([goal[d] for d in mixing.DOMAINS]))
    assert np.allclose([got[d] for d in mixing.DOMAINS], want, rtol=1e-4)
    kept = mixing.mixture(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["chosen"])


def test_steps_reach_the_least_miss(spark):
    """Random posteriors, soft and sharp, targets that can and cannot be met: as low a miss as plain projected gradient's."""
    rng = np.random.default_rng(2)
    for alpha in (0.1, 1.0):
        p = rng.dirichlet([alpha * 4, alpha, alpha], 400)
        tokens = rng.integers(0, 300, 400)
        members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>").repartition(3)
        for targets in ({"clean": 0.8, "low": 0.1, "toxic": 0.1}, {"clean": 1.0}, {"clean": 0.9, "low": 0.0, "toxic": 0.1}):
            m = mixing.fit_rates(members, targets, mixing.DOMAINS)
            have, goal = tokens @ p, np.asarray(m.goal)
            want = plain_projected_gradient(tokens, p, goal)
            cost = lambda reached: float(((np.asarray(reached) - goal) ** 2 / have).sum())
            assert cost(m.reached) <= cost(want) * 1.01 + 1e-6 * tokens.sum(), (alpha, targets)
            rates = [r["r"] for r in members.select(mixing.rate(F.col("posterior"), m.steps).alias("r")).collect()]
            assert min(rates) >= 0 and max(rates) <= 1


def test_a_scarce_domain_takes_nothing_from_the_others(spark):
    rows = [(i, 100, [0.99, 0.01, 0.0]) for i in range(500)] + [(i, 100, [0.02, 0.0, 0.98]) for i in range(500, 600)]
    members = spark.createDataFrame(rows, "id long, tokens long, posterior array<double>")
    m = mixing.fit_rates(members, {"clean": 0.96, "low": 0.02, "toxic": 0.02}, mixing.DOMAINS).steps
    got = {r["id"]: r["r"] for r in members.select("id", mixing.rate(F.col("posterior"), m).alias("r")).collect()}
    assert all(got[i] > 0.99 for i in range(500)) and all(got[i] < 0.3 for i in range(500, 600))


def test_edge_cases(spark):
    rows = [(1, None, "s", "l"), (2, "", None, None), (None, "the cat", "s", "l"), (3, "word " * 60_000, "s", None), (3, "word", "t", "l"), (4, "12 34 !!", "s", "l")]
    docs = spark.createDataFrame([(*r, 1, [1.0]) for r in rows], "doc_id long, text string, source string, lang string, tokens int, posterior array<double>")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (9, None, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert Q.classify(docs, known).count() == len(rows) and mixing.mix(docs, known).count() == len(rows)
        assert Q.classify(docs.limit(0), known).collect() == [] and mixing.mix(docs.limit(0), known).collect() == []
    assert all(r["rate"] == 1.0 for r in mixing.mix(docs, labels, {"clean": 0.0}).collect())
    assert evidence.SAMPLE >= 1000


def test_toxic_documents_go_however_common_they_are(spark):
    for toxic in (5, 50, 500):
        rows = [(i, 100, [0.998, 0.001, 0.001]) for i in range(1000)] + [(i, 100, [0.01, 0.0, 0.99]) for i in range(1000, 1000 + toxic)]
        members = spark.createDataFrame(rows, "id long, tokens long, posterior array<double>")
        share = {}
        for name, targets in (("none", corpus_pipeline.TARGETS), ("some", {"clean": 0.998, "low": 0.001, "toxic": 0.001 + 0.2 * toxic / 1000})):
            m = mixing.fit_rates(members, targets, mixing.DOMAINS, 0.0).steps
            got = {r["id"]: r["r"] for r in members.select("id", mixing.rate(F.col("posterior"), m).alias("r")).collect()}
            assert all(got[i] > 0.98 for i in range(1000))
            share[name] = got[1000]
        assert share["none"] < 0.02 and abs(share["some"] - 0.2) < 0.03


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame([(i, f"the cat {i}", "s", "l") for i in range(50)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixture(docs, none, corpus_pipeline.TARGETS).count() == 50


def test_words_tell_bad_documents_of_ordinary_shape(spark):
    common, bad = "garden window bridge summer letter", "casino wallet payout poker7 lotto7".replace("7", "s")
    text = lambda i: " ".join(f"{w} {common.split()[i % 5]}" for w in (bad if i % 4 == 0 else "forest doctor market orange silver").split())
    docs = spark.createDataFrame([(i, text(i), "s", "l") for i in range(400)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in Q.classify(docs, labels).filter("kept").collect()}
    assert kept == {i for i in range(400) if i % 4}


def _plain_sites(rows, prior):
    """(host, path) -> (host share, path share) by plain loops, from the evidence of each row."""

    def strength(sites):
        n = sum(k for k, _ in sites)
        m = min(max(sum(k * s for k, s in sites) / n, 1e-6), 1 - 1e-6)
        spread = sum(k * (s - m) ** 2 for k, s in sites) / n
        noise = m * (1 - m) * len(sites) / n
        return min(max(m * (1 - m) / max(spread - noise, 1e-9) - 1, Q.WEAKEST), Q.STRONGEST)

    paths, hosts = {}, {}
    for host, path, seen in rows:
        p = 1 / (1 + math.exp(-(seen + prior)))
        for sites, key in ((paths, (host, path)), (hosts, host)):
            n, good = sites.get(key, (0, 0.0))
            sites[key] = n + 1, good + p
    share = sum(g for _, g in paths.values()) / len(rows)
    of_host, of_path = (strength([(n, g / n) for n, g in sites.values()]) for sites in (hosts, paths))
    above = {h: (g + of_host * share) / (n + of_host) for h, (n, g) in hosts.items()}
    return {(h, q): (above[h], (g + of_path * above[h]) / (n + of_path)) for (h, q), (n, g) in paths.items()}


def test_shares_and_strengths_by_plain_loops(spark):
    """Every share of the whole table, recomputed; and of sites that differ much, so that strengths are no bounds."""
    tables = [tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))]
    good, bad = "the cat and the dog of it " * 12, "x%%% y*** z### w$$$ " * 12
    rng = np.random.default_rng(1)
    rows = [(i, good if rng.random() < 0.2 + 0.15 * (i % 5) + 0.03 * (i % 3) else bad, f"s{i % 5}", f"l{i % 3}") for i in range(900)] + [(1000, bad, None, None), (1001, good, "tiny", None)]
    labels = [(i, int(rows[i][1] == good), 0) for i in range(0, 900, 2)]
    tables.append((spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    for docs, labels in tables:
        known = [r["quality"] for r in docs.join(labels, "doc_id").collect() if r["quality"] is not None]
        prior = math.log((known.count(1) + 1) / (known.count(0) + 1))
        got = Q.classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
        want = _plain_sites([(r["source"], r["lang"], r["evidence"]) for r in got], prior)
        for r in got:
            assert np.allclose((r["host_share"], r["path_share"]), want[r["source"], r["lang"]], rtol=1e-9)


def test_quality_of_rows_held_out_of_the_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = Q.classify(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(good) > 1000 and len(bad) > 200
    assert sum(r["kept"] for r in good) > 0.99 * len(good) and sum(r["kept"] for r in bad) < 0.1 * len(bad)
