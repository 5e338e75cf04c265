"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

A classifier on measures of the text, fitted to a bounded sample of labelled documents,
gives every document its evidence. Paths and hosts then get a rate of good documents from
the mean of the classifier's probabilities over all their documents, by grouped
aggregation. Rates are Beta posteriors: a host shrinks to the global rate, a path to its
host's, each with a strength that the moments of the rates between sites give, so sparse
sites follow the prior above them. A document's own probability is taken out of its
site's sums before they judge it. The result adds the evidence, as a log likelihood ratio, to the
log odds of the path's rate.

Only measures (some 100 bytes a document) move. Site sums are combined before the shuffle;
a host with a third of all documents is one row of sums.

Cases: NULL host or path is the empty one; a NULL or empty text has measures of 0. Documents
with one id share their labels. Repeated rows count each. Without labels of both kinds the
evidence is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quality_rules import _measured

SAMPLE = 20_000  # labelled documents that the classifier is fitted to, at most in expectation
CERTAIN = 6.0  # evidence is held within this many units of log odds

def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_alnum"), F.lit(1))
    capped = lambda x: F.least(x, F.lit(1.0))
    return [
        F.log1p(F.col("n_words").cast("double")) / 10,
        F.sqrt(capped(F.col("n_symbols") / n)),
        capped(F.col("word_chars") / n / 20),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_capitals") / letters),
        F.sqrt(capped(F.col("n_shouts") / n)),
        capped(F.col("n_ends") / n),
        F.col("n_distinct_words") / n,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, size: int) -> DataFrame:
    """(doc_id, label) of about ``size`` labelled ids, chosen by a hash of the id."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(value).cast("int").alias("label"))
    share = min(1.0, size / max(ids.count(), 1))
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _logit(x: Column) -> Column:
    return F.log(x) - F.log(1 - x)


def _strength(rate: float, spread: float, noise: float) -> float:
    """Pseudo-documents of a Beta prior whose rates vary by ``spread`` beyond ``noise``."""
    between = max(spread - noise, 1e-6)
    return float(np.clip(rate * (1 - rate) / between - 1, 1.0, 1e4))


def judge_sites(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_rate, path_rate, score and kept."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        "text",
    )
    features = _features()
    names = [f"x{i}" for i in range(len(features))]
    table = materialize(
        _measured(own).select("doc_id", "host", "path", *(f.alias(n) for f, n in zip(features, names)))
    )
    learn = table.join(labelled_sample(docs, labels, "quality", sample), "doc_id").select("label", *names).toPandas()
    y = (learn["label"].to_numpy() > 0).astype(float)
    if len(y) and 0 < y.mean() < 1:
        weights, base = fit_logistic(learn[names].to_numpy(), y), float(y.mean())
    else:
        weights, base = np.zeros(len(names) + 1), 0.5
    line = F.lit(float(weights[-1]))
    for name, w in zip(names, weights):
        line = line + F.col(name) * float(w)
    evidence = F.least(F.greatest(line - float(np.log(base / (1 - base))), F.lit(-CERTAIN)), F.lit(CERTAIN))
    table = table.select("doc_id", "host", "path", evidence.alias("evidence"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))
    table = table.withColumn("p", p)

    paths = materialize(table.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = (float(whole["s"] or 0) + base) / (float(whole["n"] or 0) + 1)
    between = hosts.agg(
        F.avg((F.col("host_s") / F.col("host_n") - rate) ** 2).alias("spread"),
        F.avg(rate * (1 - rate) / F.col("host_n")).alias("noise"),
    ).first()
    strong_host = _strength(rate, between["spread"] or 0.0, between["noise"] or 0.0)
    within = paths.join(hosts, "host").agg(
        F.avg((F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2).alias("spread"),
        F.avg(rate * (1 - rate) / F.col("n")).alias("noise"),
    ).first()
    strong_path = _strength(rate, within["spread"] or 0.0, within["noise"] or 0.0)

    # Without the document's own part.
    host_rate = (strong_host * rate + F.col("host_s") - F.col("p")) / (strong_host + F.col("host_n") - 1)
    path_rate = (strong_path * F.col("host_rate") + F.col("s") - F.col("p")) / (strong_path + F.col("n") - 1)
    sites = paths.join(hosts, "host")
    near_one = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = table.join(sites, ["host", "path"]).withColumn("host_rate", near_one(host_rate))
    out = out.withColumn("path_rate", near_one(path_rate))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    return out.select(
        "doc_id", "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= 0.5).alias("kept")
    )
