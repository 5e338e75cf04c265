"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation
weighs them.

Every rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0).
Texts with equal votes are alike to the model, so expectation-maximisation runs on the
counts of vote patterns (at most 3 to the number of rules, however many documents there
are), as one small aggregate an iteration. It estimates for each rule how often it is
right about good and about bad texts. A text is kept if its posterior probability of
being good is at least one half and the base rules pass.

Cases: a NULL or empty text has no words and fails the base rules. Measures of a text
without words are 0 and all rules abstain. Repeated rows are judged alike. An empty
table gives an empty result and a model of the starting values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import SPACE, count_of, packed, quoted, unpacked, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ITERATIONS = 20
# Starting values, as pseudo-votes (right, wrong): a rule seldom objects to a good text, and
# objects only to those bad texts that are bad in its own way.
ON_GOOD = (9.9, 0.1)
ON_BAD = (2.0, 8.0)
PRIOR_GOOD, PRIOR_BAD = 3.0, 1.0

# Name, measure, bad below, good from, good to, bad above; between them a rule abstains.
RULES = [
    ("symbols", "n_symbols / n_words", None, 0.0, 0.02, 0.1),
    ("word_length", "word_chars / n_words", 2.0, 3.0, 10.0, 15.0),
    ("letters", "n_alnum / word_chars", 0.88, 0.93, 1.0, None),
    ("dup_lines", "n_dup_lines / n_lines", None, 0.0, 0.05, 0.5),
    ("repeats", "n_repeat_words / n_words", None, 0.0, 0.1, 0.3),
    ("capitals", "n_capitals / n_alnum", None, 0.0, 0.12, 0.3),
    ("shouting", "n_shouts / n_words", None, 0.0, 0.05, 0.2),
    ("sentence_ends", "n_ends / n_words", 0.005, 0.02, 0.5, 0.8),
    ("variety", "n_distinct_words / n_words", 0.1, 0.25, 1.0, None),
]


@dataclass(frozen=True)
class Model:
    """P(good) and, for each rule that votes, P(right | good) and P(right | bad)."""

    good: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]


def _measured(df: DataFrame) -> DataFrame:
    """``text`` of ``df`` measured; each step names what the next one uses more than once."""
    keep = [c for c in df.columns if c != "text"]
    own = F.coalesce(F.col("text"), F.lit(""))
    base = df.select(*keep, own.alias("text"), words(own).alias("words"))
    base = base.select(
        *keep,
        "words",
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        count_of(F.col("text"), "!?").alias("n_shouts"),
        count_of(F.col("text"), ".").alias("n_ends"),
        count_of(F.col("text"), r"\p{L}\p{N}").alias("n_alnum"),
        count_of(F.col("text"), r"\p{Lu}").alias("n_capitals"),
    )
    # Three words in a row as one 64-bit hash; equal hashes within one text are equal words.
    base = base.select(
        "*",
        F.transform(
            F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(F.col("hashes"), i + 1), F.get(F.col("hashes"), i + 2)),
        ).alias("windows"),
    )
    base = base.select(
        "*",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    twice = F.filter(
        "sorted",
        lambda x, j: (x["h"] == F.get(F.col("sorted"), j - 1)["h"]) | (x["h"] == F.get(F.col("sorted"), j + 1)["h"]),
    )
    base = base.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("starts"), k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_alnum",
        "n_capitals",
        "n_shouts",
        "n_ends",
        F.size(F.array_distinct("hashes")).alias("n_distinct_words"),
    )


def _vote(rule: tuple) -> Column:
    _, measure, bad_below, good_from, good_to, bad_above = rule
    top, bottom = measure.split(" / ")
    value = F.col(top).cast("double") / F.when(F.col(bottom) > 0, F.col(bottom).cast("double"))
    vote = F.when(value.isNull(), F.lit(0))
    if bad_below is not None:
        vote = vote.when(value < bad_below, F.lit(-1))
    if bad_above is not None:
        vote = vote.when(value > bad_above, F.lit(-1))
    return vote.when((value >= good_from) & (value <= good_to), F.lit(1)).otherwise(F.lit(0))


def _voted(df: DataFrame) -> DataFrame:
    return df.select("*", *(_vote(r).alias(f"v_{r[0]}") for r in RULES))


def _log_odds(model: Model) -> Column:
    """Log odds of good against bad, given the votes."""
    import math

    total = F.lit(math.log(model.good) - math.log(1 - model.good))
    for (name, *_), g, b in zip(RULES, model.right_good, model.right_bad):
        vote = F.col(f"v_{name}")
        total = total + (
            F.when(vote == 1, F.lit(math.log(g) - math.log(1 - b)))
            .when(vote == -1, F.lit(math.log(1 - g) - math.log(b)))
            .otherwise(F.lit(0.0))
        )
    return total


def posterior(model: Model) -> Column:
    """P(good | votes)."""
    return 1 / (1 + F.exp(-_log_odds(model)))


def start() -> Model:
    n = len(RULES)
    return Model(PRIOR_GOOD / (PRIOR_GOOD + PRIOR_BAD), (ON_GOOD[0] / sum(ON_GOOD),) * n, (ON_BAD[0] / sum(ON_BAD),) * n)


def learn(patterns: DataFrame, iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over vote patterns and their counts ``n``."""
    model = start()
    for _ in range(iterations):
        good = F.col("n") * posterior(model)
        bad = F.col("n") - good
        sums = [F.sum("g").alias("good"), F.sum("b").alias("bad")]
        for name, *_ in RULES:
            vote = F.col(f"v_{name}")
            sums += [
                F.sum(F.when(vote == 1, F.col("g"))).alias(f"gr_{name}"),
                F.sum(F.when(vote != 0, F.col("g"))).alias(f"ga_{name}"),
                F.sum(F.when(vote == -1, F.col("b"))).alias(f"br_{name}"),
                F.sum(F.when(vote != 0, F.col("b"))).alias(f"ba_{name}"),
            ]
        row = patterns.select("*", good.alias("g"), bad.alias("b")).agg(*sums).first()
        of = lambda k: row[k] or 0.0
        share = lambda r, a, prior: (of(r) + prior[0]) / (of(a) + sum(prior))
        model = Model(
            (of("good") + PRIOR_GOOD) / (of("good") + of("bad") + PRIOR_GOOD + PRIOR_BAD),
            tuple(share(f"gr_{r[0]}", f"ga_{r[0]}", ON_GOOD) for r in RULES),
            tuple(share(f"br_{r[0]}", f"ba_{r[0]}", ON_BAD) for r in RULES),
        )
    return model


def _fit(voted: DataFrame, iterations: int) -> Model:
    votes = [f"v_{r[0]}" for r in RULES]
    return learn(materialize(voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).coalesce(1)), iterations)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """One row per document: measures, base verdict, posterior, and whether it is kept.

    Measures are written once (some 100 bytes a document), then the model and the result
    read them.
    """
    measured = materialize(_measured(docs.select("doc_id", "text")))
    voted = _voted(measured)
    model = _fit(voted, iterations)
    out = voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _base_failed().alias("base_failed"), posterior(model).alias("posterior"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The documents that are kept, with all their columns.

    They are written once with their measures, so that texts are measured once and the
    filter is planned over stored columns.
    """
    rows = docs.select(packed(docs).alias("row"), docs[quoted("text")].alias("text"))
    voted = _voted(materialize(_measured(rows)))
    model = _fit(voted, iterations)
    return unpacked(voted.where(~_base_failed() & (posterior(model) >= 0.5)), "row", docs.columns)
