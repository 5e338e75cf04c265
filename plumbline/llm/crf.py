"""Language identification of words by a linear-chain conditional random field.

Every word gets one score per language from its features (character runs of one to four
with word ends marked, so prefixes and suffixes are among them, and the word itself as
lexicon entry), and neighbouring words are tied by learned transitions. Forward-backward
gives each word's probabilities; a text's language is the one with the largest sum, its
score that sum's share. So a text that switches language is labelled word by word.

The model is fitted on the driver to a bounded sample: windows of at most ``window`` words
of about ``per_language`` labelled documents per language. Windows of different languages
are joined to training sequences, which teaches the transitions what switching looks like. The
gradient is exact, with pair probabilities from the forward and backward messages, and steps end
when it is small or after a fixed number of them.
Feature weights are a table of fixed size (hashed), so the model that tasks get is bounded.

Texts of any length are labelled whole: they are cut into stretches whose transfer matrices are
multiplied for all stretches at once, so no step waits for the longest text.

Cases: a NULL text or one without a letter is ``und`` with score 0; so is every text if
no labelled document was given. Ties go to the first language in order. Repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .words import mix, slices, word_hashes

UNKNOWN = "und"
WINDOW = 60
PER_LANGUAGE = 600
JOINED = 4  # windows in one training sequence
FEATURE_BITS = 18
RUN_SIZES = (1, 2, 3, 4)
STRETCH = 64
ROUNDS = 200  # at most
SMALL = 1e-3  # largest entry of a gradient per word at which training ends
RATE = 0.15
RIDGE = 1e-5
_WORD = re.compile(r"[^\W\d_]+")
_RADIX = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # log potentials, from x to


def letter_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All runs of letters in lower case, and how many each text has."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = _WORD.findall(text.lower())
        if not all(map(str.isalpha, found)):  # other numerals than digits
            found = "".join(c if c.isalpha() else " " for w in found for c in [*w, " "]).split()
        words += found
        counts[i] = len(found)
    return words, counts


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, and the number of the word that each belongs to."""
    joined = "<" + "><".join(words) + ">"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [mix(word_hashes(words))], [np.arange(len(words))]
    total = np.zeros(len(codes), np.uint64)
    for n in RUN_SIZES:
        # Runs of n characters from runs of n - 1.
        total = total[: len(codes) - n + 1] * _RADIX + codes[n - 1 :]
        inside = owner[: len(total)] == owner[n - 1 :]
        ids.append(mix(total[inside] + np.uint64(n << 56)))
        owners.append(owner[: len(total)][inside])
    return (np.concatenate(ids) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(owners)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores of the words, one column per language."""
    ids, owners = features(words)
    return np.stack([np.bincount(owners, weights[ids, k], len(words)) for k in range(weights.shape[1])], axis=1)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's probabilities by forward-backward within its text."""
    n, k = scores.shape
    if n == 0:
        return scores
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    texts = np.flatnonzero(counts)
    per_text = -(-counts[texts] // STRETCH)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    place = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = (np.cumsum(counts) - counts)[texts][text_of] + place * STRETCH
    sizes = np.minimum(counts[texts][text_of] - place * STRETCH, STRETCH)
    # Longest first, so that each step works on a leading part.
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, text_of, place = starts[order], sizes[order], text_of[order], place[order]
    active = np.searchsorted(-sizes, -np.arange(1, STRETCH + 1), "right")
    m = len(starts)

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / x.max(axis=axes, keepdims=True)

    # Transfer matrices of the stretches; the first word of a text has no transition into it.
    first = np.where((place == 0)[:, None, None], np.eye(k), move)
    transfer = first * potential[starts][:, None, :]
    for t in range(1, STRETCH):
        a = active[t]
        if a == 0:
            break
        transfer[:a] = scaled((transfer[:a] @ move) * potential[starts[:a] + t][:, None, :], (1, 2))
    # What comes in from the left and the right of each stretch, one stretch of all texts at a time.
    left, right = np.ones((m, k)), np.ones((m, k))
    at = np.full((len(texts), int(per_text.max())), -1, np.int64)
    at[text_of, place] = np.arange(m)
    for c in range(1, at.shape[1]):
        here = at[:, c]
        on = here >= 0
        before = at[on, c - 1]
        left[here[on]] = scaled(np.einsum("ij,ijk->ik", left[before], transfer[before]), 1)
    for c in range(at.shape[1] - 2, -1, -1):
        after = at[:, c + 1]
        on = after >= 0
        right[at[on, c]] = scaled(np.einsum("ijk,ik->ij", transfer[after[on]], right[after[on]]), 1)
    out = np.empty((n, k))
    state = scaled(np.einsum("ij,ijk->ik", left, first) * potential[starts], 1)
    out[starts] = state
    for t in range(1, STRETCH):
        a = active[t]
        if a == 0:
            break
        state = scaled((state[:a] @ move) * potential[starts[:a] + t], 1)
        out[starts[:a] + t] = state
    back = right.copy()
    for t in range(STRETCH - 1, 0, -1):
        a = active[t]
        if a == 0:
            continue
        here = starts[:a] + t
        out[here] *= back[:a]
        back[:a] = scaled((potential[here] * back[:a]) @ move.T, 1)
    out[starts] *= back
    return out / out.sum(axis=1, keepdims=True)


def fit(windows: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """The model of (language, text) windows, by gradient steps on the log likelihood."""
    languages = tuple(sorted({lang for lang, _ in windows}))
    k = len(languages)
    weights = np.zeros((1 << FEATURE_BITS, k))
    transitions = np.zeros((k, k))
    shuffled = [windows[i] for i in np.random.default_rng(7).permutation(len(windows))]
    words, counts = letter_words([t for _, t in shuffled])
    if not words:
        return Model(languages, weights, transitions)
    label = np.repeat([languages.index(lang) for lang, _ in shuffled], counts)
    joined = np.add.reduceat(counts, np.arange(0, len(counts), JOINED))
    owner = np.repeat(np.arange(len(joined)), joined)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    ids, owners = features(list(distinct))
    same = owner[1:] == owner[:-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    target = np.zeros((len(words), k))
    target[np.arange(len(words)), label] = 1
    # Adaptive steps: first and second moments of the gradients.
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, transitions)]
    for r in range(1, rounds + 1):
        table = np.stack([np.bincount(owners, weights[ids, j], len(distinct)) for j in range(k)], axis=1)
        scores = table[codes]
        p, pairs = expectations(scores, joined, transitions)
        error = np.stack([np.bincount(codes, (target - p)[:, j], len(distinct)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(ids, error[owners, j], len(weights)) for j in range(k)], axis=1)
        gradients = [by_feature / len(words) - RIDGE * weights, (seen - pairs) / len(words)]
        if max(np.abs(g).max() for g in gradients) < SMALL:
            break
        for x, g, (m1, m2) in zip((weights, transitions), gradients, state):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += RATE * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-7)
    return Model(languages, weights, transitions)


def expectations(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities, and the expected number of transitions from language to language.

    For training sequences, which are of bounded length: one step for each place, all sequences at once.
    """
    n, k = scores.shape
    expected = np.zeros((k, k))
    if n == 0:
        return scores, expected
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    sizes = np.sort(counts[counts > 0])[::-1]
    starts = (np.cumsum(counts) - counts)[np.argsort(-counts, kind="stable")][: len(sizes)]
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]) + 1)]  # sequences of more than t words

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=1, keepdims=True)

    forward = np.empty((n, k))
    forward[starts] = scaled(potential[starts])
    for t in range(1, len(active) - 1):
        here = starts[: active[t]] + t
        forward[here] = scaled((forward[here - 1] @ move) * potential[here])
    backward = np.ones((n, k))
    for t in range(len(active) - 2, 0, -1):
        here = starts[: active[t]] + t
        ahead = potential[here] * backward[here]
        pair = forward[here - 1][:, :, None] * move[None] * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[here - 1] = scaled(ahead @ move.T)
    return scaled(forward * backward), expected


def bucket(doc_id: Column, parts: int) -> Column:
    """The remainder of the id's CRC-32 that decides which documents may teach."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def training_windows(
    docs: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW
) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of the labelled ``docs``, chosen by a hash of id and text.

    At most twice ``per_language`` rows of a language, those of the smallest hashes, so that repeated rows
    of one language never push out another.
    """
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(1e6 * min(1.0, per_language / n)))))
    words = F.split("text", r"\s+")
    sampled = labelled.where(chosen < share[F.col("lang")]).select("lang", "doc_id", chosen.alias("h"), words.alias("words"))
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.size("words") - window + 1, F.lit(1))).cast("int")
    rows = sampled.select("lang", "doc_id", "h", F.array_join(F.slice("words", start, window), " ").alias("text"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= 2 * per_language).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))]


_LABELLED = pa.schema(
    [
        ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))),
    ]
)


def label_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_words and the spans of words in one language of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, dtype=object)
        for part, texts in slices(batches, "text"):
            words, counts = letter_words(texts)
            n = len(texts)
            lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            spans: list[list] = [[] for _ in range(n)]
            if words and len(names):
                values = np.empty(len(words), dtype=object)
                values[:] = words
                codes, distinct = pd.factorize(values)
                p = marginals(emissions(list(distinct), model.weights)[codes], counts, model.transitions)
                owner = np.repeat(np.arange(n), counts)
                sums = np.stack([np.bincount(owner, p[:, j], n) for j in range(len(names))], axis=1)
                some = counts > 0
                # Rounded, so that languages that tie but for the order of sums do tie.
                best = np.round(sums, 9).argmax(axis=1)
                lang[some] = names[best[some]]
                score[some] = np.minimum(sums[some, best[some]] / counts[some], 1.0)
                word_lang = p.argmax(axis=1)
                edge = np.ones(len(words), bool)
                edge[1:] = (word_lang[1:] != word_lang[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(edge)
                first = np.cumsum(counts) - counts
                for w, length in zip(at, np.diff(at, append=len(words))):
                    spans[owner[w]].append(
                        {"lang": names[word_lang[w]], "start": int(w - first[owner[w]]), "length": int(length)}
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(counts),
                    pa.array(spans, _LABELLED.field("spans").type),
                ],
                schema=_LABELLED,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, lang_pred string, score double, n_words long, "
        "spans array<struct<lang:string,start:long,length:long>>",
    )
