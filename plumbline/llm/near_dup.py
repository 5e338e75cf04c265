"""Near-duplicate classes by BagMinHash signatures, bands and checked multiset overlap.

A document is the bag of its five-word runs. For every run that occurs w times, Poisson
processes over the weight levels 1..w send points to the signature's components, in rising
order; a component keeps its first point. Levels are grouped by powers of two into one
process each, whose points fall on a level inside (the hierarchy), and a process ends at
its first point beyond the last point that any component still holds. Two signatures agree
in a component with a probability of exactly the weighted Jaccard similarity.

Equal texts are one class first. Rows of the signature form bands; texts that share a band
are candidates and only those whose bags really overlap by 0.8 are linked. With 40 bands
of 6 rows, a pair at 0.8 is missed with a probability of 5 in a million. Bags whose sizes
differ by more than the similarity allows are not compared.

No bucket is expanded into all its pairs: first every member is checked against the one
that meets the most texts in all its buckets, as the origin of many copies does. Linked texts
then are one class, and only buckets that still hold several classes are looked at again:
the first member of each class is checked against that of the first class. What is left in
small buckets is compared pair by pair. Members of larger ones are compared where they differ
in the same way from what most texts around them have in common: the size of the overlap follows
from these differences, so two texts with many differences of their own never meet. Texts that share a
difference are checked against one of them first, and only what is still in several classes
is paired. This loses no class.

Cases: documents with a NULL text are classes of their own; texts without a word are a
class with those that are equal to them; a text with fewer than five words is one run of
all of them. White space and case do not count. Repeated rows fall in one class. Rows
without doc_id get a class id but no doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import packed, quoted, unpacked
from .words import bags, mix, shingles, slices, split_words, word_hashes

RUN_WORDS = 5
SIMILAR = 0.8
BANDS = 40
BAND_ROWS = 6
SMALL_BUCKET = 32  # members that are compared pair by pair; larger buckets are searched by differences
SLOTS = 1 << 20  # counters of run frequencies, which only order the runs
PART_TEXTS = 1000  # texts of a pile, which may hold a third of all rows, that one task looks up
SMALL_LINKS = 200_000  # links that one task can label without a shuffle


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Signatures of bags given as (text number, element hash, times): n_texts x size ids of points.

    Texts without elements have a row of zeros.
    """
    # One process for each power of two of weight levels: 1, 2, 3-4, 5-8, ...
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(text)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    below = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    levels = np.where(block > 1, below, 1)
    doc, top = text[owner], weight[owner] - below
    seed = mix(element[owner] + np.uint64(0xD1B54A32D192ED03) * (block.astype(np.uint64) + np.uint64(1)))
    time = np.zeros(len(owner))
    rate = levels * float(size)
    best = np.full(n_texts * size, np.inf)
    winner = np.zeros(n_texts * size, np.uint64)
    step = 0
    while len(doc):
        step += 1
        point = mix(seed + np.uint64(0x9E3779B97F4A7C15 * step % 2**64))
        time = time - np.log(_unit(point)) / rate
        place = mix(point ^ np.uint64(0xA0761D6478BD642F))
        level = (mix(place) % levels.astype(np.uint64)).astype(np.int64)
        inside = level < top
        at = doc * size + (place % np.uint64(size)).astype(np.int64)
        own_at, own_time = at[inside], time[inside]
        np.minimum.at(best, own_at, own_time)
        won = best[own_at] == own_time
        winner[own_at[won]] = point[inside][won]
        limit = best.reshape(n_texts, size).max(axis=1)
        on = time <= limit[doc]
        doc, top, seed, time, rate, levels = doc[on], top[on], seed[on], time[on], rate[on], levels[on]
    return winner.reshape(n_texts, size)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (doc, digest, size of the bag, bands); texts without words have no bands."""
    for part, texts in slices(batches, "text"):
        words, counts = split_words(texts)
        text, element, times = bags(*shingles(word_hashes(words), counts, RUN_WORDS))
        signature = bag_minhash(text, element, times, len(texts), BANDS * BAND_ROWS)
        rows = signature.reshape(len(texts), BANDS, BAND_ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
        for r in range(BAND_ROWS):
            key = mix(key ^ rows[:, :, r])
        key = key.view(np.int64)
        digests = [
            None if null else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
            for t, null in zip(texts, part.column("text").is_null().to_pylist())
        ]
        sizes = np.bincount(text, times, len(texts)).astype(np.int64)
        bands = pa.array([k if n else [] for k, n in zip(key, counts)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc"), pa.array(digests, pa.string()), pa.array(sizes), bands], ["doc", "digest", "size", "bands"]
        )


def _overlap(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the (a, b) whose bags overlap enough."""
    last: tuple = (None, None)

    def bag(text: str):
        words, counts = split_words([text])
        _, element, times = bags(*shingles(word_hashes(words), counts, RUN_WORDS))
        return element, times

    for batch in batches:
        near = []
        for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
            if last[0] != a:
                last = (a, bag(text_a))
            (ea, na), (eb, nb) = last[1], bag(text_b)
            at = np.minimum(np.searchsorted(ea, eb), max(len(ea) - 1, 0))
            common = ea[at] == eb if len(ea) else np.zeros(len(eb), bool)
            shared = int(np.minimum(na[at[common]], nb[common]).sum())
            # similar is compared on whole numbers scaled up, so that 0.8 is exact.
            near.append(shared * 10_000 >= round(similar * 10_000) * (int(na.sum()) + int(nb.sum()) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) with one token for each run and time that it occurs in the text."""
    words, counts = split_words(texts)
    text, element, times = bags(*shingles(word_hashes(words), counts, RUN_WORDS))
    owner = np.repeat(np.arange(len(text)), times)
    again = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    return text[owner], mix(element[owner] + np.uint64(0x8BB84B93962EACC9) * again.astype(np.uint64))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pile, texts, text) to (pile, texts, token, number of the slice's texts with it), without tokens of one text.

    What a pile has in common, and the order of tokens, may be any; these counts only make them fit.
    """
    for part, texts in slices(batches, "text"):
        text, token = _tokens(texts)
        pile, whole = part.column("pile").to_numpy()[text], part.column("texts").to_numpy()[text]
        order = np.lexsort((token, pile))
        pile, whole, token = pile[order], whole[order], token[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (pile[1:] != pile[:-1])
        starts = np.flatnonzero(first)
        times = np.diff(starts, append=len(token))
        starts, times = starts[times > 1], times[times > 1]
        columns = [pile[starts], whole[starts], token[starts].view(np.int64), times]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pile", "texts", "token", "n"])


def _differences(batches: Iterator[pa.RecordBatch], often: np.ndarray, scaled: int) -> Iterator[pa.RecordBatch]:
    """Texts with their differences from what their pile has in common, in ``tokens``.

    Differences stand in one order for all texts of a pile, rare ones first; ``left`` counts those from
    each one on, and those that come too late for any pair are left out. ``slack``: how much the differences
    stay below half of what a pair of this size may have, times 10,000 + ``scaled``.
    """
    for part, texts in slices(batches, "text"):
        text, token = _tokens(texts)
        ends = np.cumsum(np.bincount(text, minlength=len(texts)))
        of = part.column("common")
        piles, sizes = part.column("texts").to_numpy(), part.column("size").to_numpy()
        tokens, lefts, slacks = [], [], np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            own = token[ends[i - 1] if i else 0 : ends[i]]
            common = of[i].values.to_numpy().view(np.uint64) if of[i].is_valid else own[:0]
            odd = np.setxor1d(own, common)
            seen = often[(odd % np.uint64(SLOTS)).astype(np.int64)]
            seen = np.where(np.isin(odd, common), np.maximum(piles[i] - seen, 0), seen)
            odd = odd[np.lexsort((odd, seen))]
            slack = int(sizes[i]) * (10_000 - scaled) - len(odd) * (10_000 + scaled)
            most = int(sizes[i]) * 10_000 // scaled * (10_000 - scaled) + 10_000  # of any partner
            left = len(odd) - np.arange(len(odd))
            keep = 2 * left * (10_000 + scaled) >= -(slack + most)
            tokens.append(odd[keep].view(np.int64))
            lefts.append(left[keep].astype(np.int64))
            slacks[i] = slack
        names = ["pile", "texts", "node", "label", "size"]
        edges = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in (tokens, lefts)]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), *lists, pa.array(slacks)], [*names, "tokens", "left", "slack"]
        )


def _by_pile(rows: DataFrame, facts: DataFrame, spread: str) -> DataFrame:
    """Rows (with the texts of their pile counted) with the facts of their pile, dealt over tasks by ``spread``."""
    salts = F.ceil(F.col("texts") / PART_TEXTS).cast("int")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("texts")
    return salted.join(copies, ["pile", "salt"]).drop("salt")


def _crowd_rows(crowd: DataFrame, scaled: int) -> DataFrame:
    """The texts of piles with their differences, from (pile, texts, node, label, size, text)."""
    # Some texts of a pile together, so that tokens are counted where they are.
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("texts") / PART_TEXTS)).cast("int")
    parts = crowd.select("pile", "texts", "text", part.alias("part")).repartition("pile", "part").sortWithinPartitions("pile", "part")
    counts = materialize(
        parts.select("pile", "texts", "text").mapInArrow(_token_counts, "pile long, texts long, token long, n long")
        .groupBy("pile", "texts", "token").agg(F.sum("n").alias("n"))
    )
    # A token's remainder as unsigned number, as in _differences.
    rest = F.pmod("token", F.lit(SLOTS)).cast("int")
    slots = counts.groupBy(rest.alias("slot")).agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    # Tokens of most texts of a pile: no more than twice the words of a text.
    common = counts.where(F.col("n") * 2 > F.col("texts")).groupBy("pile", "texts")
    piles = crowd.select("pile", "texts").distinct()
    common = piles.join(common.agg(F.collect_list("token").alias("common")), ["pile", "texts"], "left")
    return materialize(
        _by_pile(crowd, common, "node").select("pile", "texts", "node", "label", "size", "common", "text").mapInArrow(
            lambda it: _differences(it, often, scaled),
            "pile long, texts long, node long, label long, size long, tokens array<long>, left array<long>, slack long",
        )
    )


def _shared_differences(rows: DataFrame, labels: DataFrame, scaled: int) -> DataFrame:
    """(pile, token, node, label, size, left, slack) for differences that several classes of a pile share.

    ``rows`` hold the most slack of their pile, in ``best``.
    """
    late = 2 * (10_000 + scaled)
    named = rows.join(labels.withColumnRenamed("label", "now"), "node", "left").withColumn("label", F.coalesce("now", "label"))
    early = F.filter(
        F.arrays_zip("tokens", "left"), lambda x: x["left"] * F.lit(late) >= -(F.col("slack") + F.col("best"))
    )
    single = named.select("pile", "node", "label", "size", "slack", F.explode(early).alias("x"))
    single = materialize(single.select("pile", "node", "label", "size", "slack", F.col("x.tokens").alias("token"), F.col("x.left").alias("left")))
    mixed = single.groupBy("pile", "token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return materialize(single.join(mixed.where("low <> high").select("pile", "token"), ["pile", "token"]))


def _may_be_near(scaled: int, similar: float, other: str) -> Column:
    """Whether two texts that share a difference of both can be near and are of different classes."""
    slack = F.col("slack") + F.col(f"{other}slack")
    early = F.least("left", f"{other}left") * F.lit(2 * (10_000 + scaled)) >= -slack
    return (F.col("label") != F.col(f"{other}label")) & (slack < 0) & early & _near_in_size("size", f"{other}size", similar)


def _crowd_labels(crowd: DataFrame, bodies: DataFrame, labels: DataFrame, checked: DataFrame, similar: float) -> DataFrame:
    """``labels`` where all of a pile that is near is connected, from (pile, texts, node, label, size, text).

    With x' and y' the differences of two bags from anything in common, |x| + |y| less twice the overlap
    is |x'| + |y'| less twice |x' and y'|. Bags with enough slack are near without a shared difference,
    then both are near the text with the most slack; all others share one early enough.
    """
    scaled = round(similar * 10_000)
    rows = _crowd_rows(crowd, scaled)
    best = rows.groupBy("pile", "texts").agg(F.max(F.struct("slack", "node", "label")).alias("top"))
    rows = materialize(_by_pile(rows, best, "node"))
    star = rows.where((F.col("label") != F.col("top.label")) & (F.col("slack") + F.col("top.slack") >= 0))
    star = star.select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    rows = rows.withColumn("best", F.col("top.slack"))

    def more(pairs: DataFrame, labels: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = materialize(_ordered(pairs).join(checked, ["a", "b"], "left_anti"))
        return _extended(labels, _links(new, bodies, similar)), checked.unionByName(new)

    labels, checked = more(star, labels, checked)
    # Of the texts that share a difference, all against the one with the most slack.
    shared = _shared_differences(rows, labels, scaled)
    heads = shared.groupBy("pile", "token").agg(F.max(F.struct("slack", "node", "label", "size", "left")).alias("h"))
    met = shared.join(heads, ["pile", "token"]).withColumns({f"h_{c}": F.col(f"h.{c}") for c in ("slack", "node", "label", "size", "left")})
    met = met.where(_may_be_near(scaled, similar, "h_")).select(F.col("h_node").alias("a"), F.col("node").alias("b"))
    labels, checked = more(met, labels, checked)
    # What is in several classes still.
    shared = _shared_differences(rows, labels, scaled)
    other = shared.select("pile", "token", *(F.col(c).alias(f"o_{c}") for c in ("node", "label", "size", "left", "slack")))
    pairs = shared.join(other, ["pile", "token"]).where((F.col("label") < F.col("o_label")) & _may_be_near(scaled, similar, "o_"))
    return more(pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")), labels, checked)[0]


def _links(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs that are similar. The smaller side of a pair, which many pairs may share, joins last."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(
        both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _overlap(it, similar), "a long, b long")
    )


def classes(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest node that it is connected with.

    Each round, a node takes the smallest label around it and then that label's own label,
    so a chain halves. Only a count of changes reaches the driver.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    small = both.count() <= SMALL_LINKS
    fit = lambda df: df.coalesce(1) if small else df
    both = fit(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        labels = fit(labels)
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("label").alias("around"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = materialize(
            moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        )
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def _extended(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels with more links: only classes that these connect are labelled anew."""
    named = found
    for c in ("a", "b"):
        known = labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        named = named.join(known, c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    edges = materialize(named.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if edges.isEmpty():
        return labels
    moved = classes(edges)
    kept = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    new = moved.join(labels.select("node"), "node", "left_anti")
    return materialize(kept.select("node", F.coalesce("to", "label").alias("label")).unionByName(new))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with more than one class, with their class."""
    named = members.join(labels, "node", "left").select("key", "node", "size", "rank", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")
    )
    return materialize(named.join(mixed.where("low <> high").select("key", "members"), "key"))


def _near_in_size(a: str, b: str, similar: float) -> Column:
    return F.least(a, b) * 10_000 >= round(similar * 10_000) * F.greatest(a, b)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, digest of its text, class_id (the smallest doc_id of its class) and the
    digest of that document's text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text"))
    signed = materialize(own.mapInArrow(_signed, "doc long, digest string, size long, bands array<long>"))
    copies = signed.where("digest is not null").groupBy("digest").agg(
        F.min("doc").alias("first_doc"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    # The ids are fixed by writing them.
    texts = materialize(copies.select(F.monotonically_increasing_id().alias("node"), "digest", "first_doc", "size", "bands"))
    bands = texts.select("node", "size", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(bands.join(shared, "key"))
    # How many others a text meets: the one that most copies come from meets the most.
    met = members.groupBy("node").agg(F.struct(F.sum("n").alias("met"), (-F.col("node")).alias("order")).alias("rank"))
    members = materialize(members.select("key", "node", "size").join(met, "node"))
    candidates = members.select("node").distinct().join(texts.select("node", "digest", "first_doc"), "node")
    wanted = own.select("doc", F.md5(F.col("text").cast("binary")).alias("digest"), "text").join(
        candidates.select("node", "digest", F.col("first_doc").alias("doc"), F.lit(True).alias("has")),
        ["digest", "doc"],
    )
    # Rows without doc_id cannot be found by it: they are looked up by their text alone.
    lost = own.where("doc is null").select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").join(
        candidates.where("first_doc is null").select("node", "digest"), "digest"
    )
    bodies = materialize(
        wanted.select("node", "text").unionByName(lost.select("node", "text")).groupBy("node").agg(F.first("text").alias("text"))
    )

    centres = members.groupBy("key").agg(F.max(F.struct("rank", "node", "size")).alias("centre"))
    star = members.join(centres, "key").where(
        (F.col("node") != F.col("centre.node")) & _near_in_size("size", "centre.size", similar)
    )
    checked = materialize(_ordered(star.select(F.col("centre.node").alias("a"), F.col("node").alias("b"))))
    links = _links(checked, bodies, similar)
    labels = classes(links)
    mixed = _mixed(members, labels)

    # Of each class in a bucket, the first member against that of the first class.
    heads = mixed.groupBy("key", "label").agg(F.max(F.struct("rank", "node", "size")).alias("head"))
    first = heads.groupBy("key").agg(F.max("head").alias("first"))
    pairs = heads.join(first, "key").where(
        (F.col("head.node") != F.col("first.node")) & _near_in_size("head.size", "first.size", similar)
    )
    pairs = _ordered(pairs.select(F.col("first.node").alias("a"), F.col("head.node").alias("b")))
    pairs = materialize(pairs.join(checked, ["a", "b"], "left_anti"))
    found = _links(pairs, bodies, similar)
    checked = checked.unionByName(pairs)
    if not found.isEmpty():
        labels = _extended(labels, found)
        mixed = _mixed(members, labels)

    # All that may still be near: members of different classes.
    few = mixed.where(F.col("members") <= SMALL_BUCKET)
    left = few.select("key", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("label").alias("la"))
    right = few.select("key", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("la") < F.col("lb")) & _near_in_size("sa", "sb", similar))
    pairs = materialize(_ordered(pairs.select("a", "b")).join(checked, ["a", "b"], "left_anti"))
    labels = _extended(labels, _links(pairs, bodies, similar))
    many = mixed.where(F.col("members") > SMALL_BUCKET)
    if not many.isEmpty():
        # Texts that meet in large buckets, directly or by others, are one pile. A text holds to one of
        # the hubs it meets, and that one to the others.
        hubs = many.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("hub"))
        meet = many.join(hubs, "key").select("node", F.col("hub.node").alias("hub")).distinct()
        own = meet.groupBy("node").agg(F.max("hub").alias("b"))
        ties = meet.join(own, "node").select(F.col("hub").alias("a"), "b")
        ties = ties.unionByName(own.select(F.col("node").alias("a"), "b")).where("a <> b").distinct()
        piles = classes(ties)
        crowd = many.select("node", "label", "size").distinct().join(piles.select("node", F.col("label").alias("pile")), "node")
        sizes = piles.groupBy(F.col("label").alias("pile")).agg(F.count(F.lit(1)).alias("texts"))
        crowd = materialize(crowd.join(sizes, "pile").join(bodies, "node"))
        labels = _crowd_labels(crowd, bodies, labels, checked.unionByName(pairs), similar)

    named = texts.join(labels, "node", "left").select(
        "digest", "first_doc", F.coalesce("label", "node").alias("label")
    )
    # The smallest (doc_id, digest) of a class stands for it; a text with a doc_id before any without.
    first = F.min(F.struct(F.col("first_doc").isNull().alias("lost"), "first_doc", "digest"))
    ids = named.groupBy("label").agg(first.alias("first"))
    named = named.join(ids, "label").select(
        "digest", F.col("first.first_doc").alias("class_id"), F.col("first.digest").alias("class_digest")
    )
    return (
        signed.select(F.col("doc").alias("doc_id"), "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            "class_digest",
        )
    )


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest doc_id and, of
    several texts under it, the smallest digest.

    Of rows repeated with that id and text, one stays. Documents with a NULL text all stay.
    """
    verdict = near_classes(docs.select("doc_id", "text"), similar)
    key = lambda doc, digest: F.coalesce(doc, F.xxhash64(digest))
    stay = (
        verdict.where("digest = class_digest and doc_id <=> class_id")
        .select("digest", key(F.col("doc_id"), F.col("digest")).alias("key"))
        .distinct()
    )
    digest = F.md5(docs[quoted("text")].cast("binary"))
    rows = docs.select(
        packed(docs).alias("row"), digest.alias("digest"), key(docs[quoted("doc_id")].cast("long"), digest).alias("key")
    )
    found = rows.join(stay, ["digest", "key"], "left_semi").groupBy("digest", "key").agg(F.first("row").alias("row"))
    whole = found.select("row").unionByName(rows.where("digest is null").select("row"))
    return unpacked(whole, "row", docs.columns)
