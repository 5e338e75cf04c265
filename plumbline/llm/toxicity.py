"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are scored by the log-odds of toxic against clean documents under a Dirichlet prior in
the proportions of the whole corpus; only what exceeds its own uncertainty counts, and
all other tokens cost a little. One linear scan of a text finds all its maximal segments
(every segment whose score no extension or part of it beats, after Ruzzo and Tompa).
Segment scores follow an extreme-value law on clean text; its scale is the root of the
moment equation of the token scores, its place is fitted to all clean documents of the sample;
one without a segment counts as one whose best score stayed below the least a segment can have. So a
segment has the probability that a clean text of that length holds one as good, and the
significant ones are reported. A text's evidence, the sum of its significant segments' log
probabilities, is turned to a probability by a logistic curve fitted to the labelled sample.

Corpus counts come from all documents. Tokens are known by their 64-bit hash and counted, once a
document, one row per slice of text and token, added up by Spark before and after the shuffle. Only
tokens of toxic documents can score, so only their counts reach the driver and only those with
a positive score are sent to the tasks. Labels come from a bounded sample of labelled documents, which
bounds both, and which is small enough to be sent to every task.

Cases: a NULL or empty text has no tokens and no segment, and gets the score of no evidence.
Documents with one id share a label (1 if any row says so). Without labels of both kinds
every score is 0. Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .site_quality import fit_logistic, labelled_sample
from .words import mix, slices, split_words, word_hashes

SAMPLE = 20_000  # labelled documents that teach, at most in expectation
PRIOR_TOKENS = 0.1  # tokens of the prior, as a share of the labelled tokens
# SURE and SIGNIFICANT: fewest errors in cross-validation (4 and 10 folds) over the teaching rows of sf0.1.
SURE = 1.75  # deviations that a token's log-odds must exceed
COST = 0.1  # what a token without evidence takes from a segment
SIGNIFICANT = 0.05
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # hashes of the tokens with a positive score, in order
    scores: np.ndarray  # theirs
    cost: float  # what any other token takes
    scale: float  # of the extreme-value law
    log_k: float  # its place
    slope: float
    intercept: float


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and how many each has."""
    words, counts = split_words(texts, letters=True)
    return mix(word_hashes(words)).view(np.int64), counts


def token_counts(docs: DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Documents with each token (token, n, toxic, clean), for tokens of toxic ones, and the sums over all tokens.

    A token counts once for each document, so one document that repeats a word proves little.
    ``docs`` has text and label (NULL: not labelled).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            ids, counts = tokens(texts)
            codes, found = pd.factorize(ids)
            if not len(found):
                continue
            once = np.unique(np.repeat(np.arange(len(counts)), counts) * len(found) + codes)
            codes, doc = once % len(found), once // len(found)
            label = part.column("label").fill_null(-1).to_numpy(zero_copy_only=False)[doc]
            rows = [np.bincount(x, minlength=len(found)) for x in (codes, codes[label == 1], codes[label == 0])]
            # The row without a token holds the sums.
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *found.tolist()], pa.int64()), *(pa.array(np.append(r.sum(), r)) for r in rows)],
                ["token", "n", "toxic", "clean"],
            )

    names = ["n", "toxic", "clean"]
    parts = docs.select("text", "label").mapInArrow(run, "token long, n long, toxic long, clean long")
    rows = parts.groupBy("token").agg(*(F.sum(c).alias(c) for c in names))
    # As many rows as the bounded sample's toxic documents have tokens. pandas would turn a NULL's column to floats.
    found = rows.where("token is null or toxic > 0").selectExpr("token is null as whole", "coalesce(token, 0) as token", *names)
    found = found.toPandas()
    return found[~found["whole"]], found.loc[found["whole"], names].sum().to_numpy(float)


def token_scores(counts: pd.DataFrame, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-odds beyond their uncertainty, 0 where nothing is left, and the cost of a token without evidence."""
    total, toxic, clean = (counts[c].to_numpy(float) for c in ("n", "toxic", "clean"))
    n, n1, n0 = sums
    share = total / max(n, 1.0)
    weight = PRIOR_TOKENS * (n1 + n0)
    prior = np.maximum(weight * share, 1e-3)
    odds = lambda y, n: np.log(y + prior) - np.log(n + weight - y - prior)
    delta = odds(toxic, n1) - odds(clean, n0)
    sure = delta - SURE * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    scores = np.where(sure > 0, sure, 0.0)
    # The mean score of a clean text must be negative, or segments would grow without end.
    return scores, max(COST, 2 * float((share * scores).sum()))


def values_of(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, cost: float) -> np.ndarray:
    """The score of every token; ``known`` holds the tokens with a positive one, in order."""
    if not len(known):
        return np.full(len(ids), -cost)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, scores[at], -cost)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one text, in order, in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    # Neighbours of one sign act as one.
    edge = np.flatnonzero(np.diff(positive, prepend=~positive[0]))
    ends = np.append(edge[1:], len(scores))
    sums = np.add.reduceat(scores, edge)
    found: list[list] = []  # start, end, sum before, sum up to its end, the last one with a smaller left sum
    total = 0.0
    for a, b, s, up in zip(edge.tolist(), ends.tolist(), sums.tolist(), positive[edge].tolist()):
        before = total
        total += s
        if not up:
            continue
        start, left = a, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([start, b, left, total, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def scale_of(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * score)) = 1."""
    high = 1e-3
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if not (scores[share > 0] > 0).any():
        return 1.0
    while value(high) < 0 and high < 1e3:
        high *= 2
    low = 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(low, 1e-6)


def place_of(best: np.ndarray, n: np.ndarray, scale: float, least: float) -> float:
    """Place of the law, by maximum likelihood over clean texts of ``n`` tokens.

    ``best`` is a text's best score; 0 stands for no segment, so for any score below ``least``.
    """
    best, n = best[n > 0], n[n > 0]
    if not len(n):
        return 0.0
    expected = np.log(n) - scale * np.where(best > 0, best, least)
    return math.log(max(np.count_nonzero(best > 0), 0.5)) - float(np.logaddexp.reduce(expected))


def log_p(score: float, n: int, scale: float, log_k: float) -> float:
    """Log probability that a clean text of n tokens holds a segment of this score."""
    expected = math.exp(min(log_k + math.log(max(n, 1)) - scale * score, 50.0))
    return math.log(-math.expm1(-expected)) if expected > 1e-12 else log_k + math.log(max(n, 1)) - scale * score


def _scan(values: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, float]]]:
    ends = np.cumsum(counts)
    some = np.add.reduceat(np.append(values > 0, False), np.append(ends - counts, len(values)))[:-1] if len(counts) else []
    return [
        segments(values[e - n : e]) if n and hit else [] for e, n, hit in zip(ends, counts, some)
    ]


def _evidence(found: list[tuple[int, int, float]], n: int, scale: float, log_k: float) -> list[tuple[int, int, float, float]]:
    """The significant segments with their log probabilities."""
    rated = ((a, b, s, log_p(s, n, scale, log_k)) for a, b, s in found)
    return [x for x in rated if x[3] <= math.log(SIGNIFICANT)]


def _sum_of_logs(rated: list[tuple[int, int, float, float]]) -> float:
    return math.log1p(-sum(x[3] for x in rated))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``labels`` (doc_id, toxic), whatever rows it is given, and the texts of all ``docs``."""
    chosen = labelled_sample(docs, labels, "toxic", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, sums = token_counts(rows.join(F.broadcast(chosen), "doc_id", "left"))
    if not sums[1] or not sums[2]:
        return Model(np.zeros(0, np.int64), np.zeros(0), COST, 1.0, 0.0, 0.0, -50.0)
    scores, cost = token_scores(counts, sums)
    positive = scores > 0
    known, share = counts["token"].to_numpy(np.int64)[positive], counts["clean"].to_numpy(float)[positive] / sums[2]
    order = np.argsort(known)
    known, scores, share = known[order], scores[positive][order], share[order]
    scale = scale_of(np.append(scores, -cost), np.append(share, 1 - share.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            ids, sizes = tokens(texts)
            found = _scan(values_of(ids, *shared.value), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("label"), pa.array(sizes),
                    pa.array([[s for *_, s in x] for x in found], pa.list_(pa.float64())),
                ],
                ["label", "n", "scores"],
            )

    shared = docs.sparkSession.sparkContext.broadcast((known, scores, cost))
    learn = rows.join(F.broadcast(chosen), "doc_id").select("label", "text")
    learn = learn.mapInArrow(run, "label int, n long, scores array<double>").toPandas()  # the bounded sample
    best = np.array([max(x, default=0.0) for x in learn["scores"]])
    n, y = learn["n"].to_numpy(), (learn["label"].to_numpy() > 0).astype(float)
    log_k = place_of(best[y == 0], n[y == 0], scale, min(scores, default=0.0))
    evidence = np.array(
        [_sum_of_logs(_evidence([(0, 0, s) for s in x], m, scale, log_k)) for x, m in zip(learn["scores"], n)]
    )
    slope, intercept = fit_logistic(evidence[:, None], y, ridge=1e-3)
    return Model(known, scores, cost, scale, log_k, max(float(slope), 0.0), float(intercept))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the significant passages (in tokens) of every text."""
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in slices(batches, "text"):
            ids, sizes = tokens(texts)
            found = _scan(values_of(ids, m.tokens, m.scores, m.cost), sizes)
            rated = [_evidence(x, int(n), m.scale, m.log_k) if x else [] for x, n in zip(found, sizes)]
            score = [1 / (1 + math.exp(-(m.intercept + m.slope * _sum_of_logs(x)))) for x in rated]
            passages = [
                [{"start": a, "length": b - a, "score": s, "p": math.exp(p)} for a, b, s, p in x] for x in rated
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(score, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(passages, kind),
                ],
                ["doc_id", "score", "predicted", "passages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, score double, predicted int, "
        "passages array<struct<start:long,length:long,score:double,p:double>>",
    )
