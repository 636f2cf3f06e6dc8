"""Quality classifier by hierarchical empirical Bayes.

The words and shape of a document give a likelihood ratio of good against bad. Its prior comes from where it was
found: the share of good documents at its path, shrunk towards that of its host, which is shrunk towards that of all.
The strength of each shrinkage is estimated from how much the sites differ (method of moments), so a site with few
documents says little and one with many says what its documents say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm import evidence
from hopflow.llm.common import fresh, let, written

#: Bounds of the shrinkage strength, in documents, and of the share that a site may reach.
WEAKEST, STRONGEST, EDGE = 5.0, 1000.0, 0.02
#: A document is kept from this posterior on; below one half, since a good document lost weighs more than a bad one kept.
KEEP_FROM = 0.25
CLASSES = ["bad", "good"]
#: Words of the learned lexicon, at most.
LEXICON = 256


@dataclass
class Model:
    evidence: evidence.Evidence
    #: columns _host, _path, _host_share, _path_share; one row for each path
    sites: DataFrame
    share: float


def _likelihood_ratio(e: evidence.Evidence, text: Column) -> Column:
    return let(evidence.log_likelihoods(e, text), lambda ll: ll[1] - ll[0])


def _logit(p: Column) -> Column:
    return let(p, lambda x: F.log(x / (1 - x)))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame, share: str, n: str) -> float:
    """The number of documents that the prior of a level is worth, from the spread of the shares of its sites."""
    r = sites.agg(F.sum(n).alias("n"), (F.sum(F.col(n) * F.col(share)) / F.sum(n)).alias("m")).first()
    if not r["n"]:
        return WEAKEST
    m = min(max(r["m"], 1e-6), 1 - 1e-6)
    spread = sites.agg((F.sum(F.col(n) * F.pow(F.col(share) - m, 2)) / F.sum(n)).alias("v"), F.count("*").alias("k")).first()
    noise = m * (1 - m) * spread["k"] / r["n"]
    return min(max(m * (1 - m) / max(spread["v"] - noise, 1e-9) - 1, WEAKEST), STRONGEST)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = evidence.SAMPLE) -> Model:
    """Evidence from a bounded sample of labelled documents, priors from all documents.

    Site shares are sums over the classifier's posteriors of every document, added up on the map side."""
    labelled = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("class"))
    e = evidence.fit(docs, labelled, CLASSES, id_col, text_col, lexicon_size=LEXICON, sample=sample)
    p = _sigmoid(_likelihood_ratio(e, F.col(text_col)) + (e.prior[1] - e.prior[0]))
    alone = docs.select(F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), p.alias("_p"))
    paths = written(alone.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("good")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = min(max((total["good"] or 0.0) / (total["n"] or 1), EDGE), 1 - EDGE) if total["n"] else 0.5
    k_host = _strength(hosts.withColumn("share", F.col("host_good") / F.col("host_n")), "share", "host_n")
    k_path = _strength(paths.withColumn("share", F.col("good") / F.col("n")), "share", "n")
    hosts = hosts.withColumn("_host_share", (F.col("host_good") + k_host * share) / (F.col("host_n") + k_host))
    both = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    sites = both.select("_host", "_path", "_host_share", ((F.col("good") + k_path * F.col("_host_share")) / (F.col("n") + k_path)).alias("_path_share"))
    return Model(e, written(sites, "sites"), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", name: str = "_quality") -> DataFrame:
    """docs with a struct `name`: evidence, host_share, path_share, quality_score. Columns of docs keep their values.

    Sites that the model has not seen take the share of all documents."""
    seen, host, path, of_host, of_path = (fresh(docs, c) for c in ("_seen", "_host", "_path", "_host_share", "_path_share"))
    sites = model.sites.select(F.col("_host").alias(host), F.col("_path").alias(path), F.col("_host_share").alias(of_host), F.col("_path_share").alias(of_path))
    scored = docs.withColumn(seen, _likelihood_ratio(model.evidence, F.col(text_col)))
    met = scored.join(sites, F.col(host_col).eqNullSafe(F.col(host)) & F.col(path_col).eqNullSafe(F.col(path)), "left")
    host_share, path_share = F.coalesce(of_host, F.lit(model.share)), F.coalesce(of_path, F.lit(model.share))
    prior = F.least(F.greatest(path_share, F.lit(EDGE)), F.lit(1 - EDGE))
    found = F.struct(F.col(seen).alias("evidence"), host_share.alias("host_share"), path_share.alias("path_share"), _sigmoid(F.col(seen) + _logit(prior)).alias("quality_score"))
    return met.withColumn(name, found).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The id of every row, evidence (log-likelihood ratio), host_share, path_share, quality_score, kept.

    A null or empty text is judged by the bins that texts without words have; null hosts and paths are sites of their
    own; repeated rows are judged alike. Without labels every document has the evidence 0 and is judged by an even
    prior. An empty table gives no rows; other columns of either table are ignored."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    model = fit(slim, labels, "id", "text", "host", "path")
    done = score(slim, model, "text", "host", "path")
    q = F.col("_quality")
    return done.select(F.col("id").alias(id_col), q["evidence"].alias("evidence"), q["host_share"].alias("host_share"), q["path_share"].alias("path_share"), q["quality_score"].alias("quality_score"), (q["quality_score"] >= KEEP_FROM).alias("kept"))
