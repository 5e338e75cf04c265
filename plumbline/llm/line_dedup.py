"""Line dedup with a tree of line templates.

Lines are parsed by a tree of fixed depth: first by token count, then by the leading
tokens; tokens with a digit are variable fields from the start (``<*>``). Within a leaf, lines are of
one template if at least ``similar`` of their tokens agree, place by place, and most of those after the
leading ones, which a leaf has in common by definition. A leaf holds as many templates as its
lines need, so a foreign line undoes none.

Lines of a leaf meet without being paired. Each is compared with the earliest line of its leaf; most leaves hold
one template and end there. In the others the tokens after the leading ones are cut into a fixed number of fields.
Lines that agree in any set of fields that is enough by itself are one template: each smallest such
set is a group. Scattered differences are found by shorter fields: lines of one template differ in a
bounded number of tokens after the leading ones, so of one field more than that at least one is equal. A line is compared, token by
token, with the earlier lines of such an equal field, the earliest of them first and more in each round, until none is
left that would take it to an earlier document; no line of a template is missed. Lines of
a field that very many share are dealt into parts.

A template in two documents or more recurs. Its lines stay in the document with the
smallest id and are dropped from all others, so one copy of each text remains: a line goes from
every document but the first one that has the line or an earlier one of its template.

Only hashes move: some 70 bytes a line and four a token. Only lines of leaves with different
lines are looked at again, each distinct one once. Groups that a third of all lines may belong to are
aggregated before they are shuffled, and written before lines are joined to them, so that adaptive execution
can split them.

Cases: a NULL text stays NULL; lines without a token are kept and are no template; lines
repeated within one document only are kept; rows with one doc_id are one document; a
document without id is known by its text; a text whose lines all go becomes empty. A very
long line is one row of token hashes. Ties between earliest lines go to the smaller line number. Other
columns are kept or not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .columns import SPACE, packed, quoted, unpacked, with_text

DEPTH = 3
FIELDS = 8
SIMILAR = 0.7
LEAVES = 1_000_000  # leaves with different lines that are handed to all tasks, 16 MB; more are joined by a shuffle
CROWD = 10_000  # lines of a shared field that are compared with others in one task
HEADS = 4  # lines of a shared field that others are compared with in the first round
MORE_HEADS = 8  # times as many in each round after it
VARIABLE = "<*>"
# A whole token with a digit in it. The quantifiers never go back, so long tokens cost linear time.
FIELD_TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def _cut(i: int | Column, tail: Column, fields: int | Column = FIELDS) -> Column:
    """Where field ``i`` of a tail of so many tokens begins."""
    return F.floor(tail * i / fields).cast("int")


def _field(i: int | Column, tail: Column, fields: int | Column = FIELDS) -> Column:
    """The tokens of field ``i``."""
    begin = _cut(i, tail, fields)
    return F.slice("tokens", begin + DEPTH + 1, _cut(i + 1, tail, fields) - begin)


def parse_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a token: document, line number, leaf, hashes of the line, its fields and its tokens."""
    lines = docs.select(
        _key(F.col("doc_id"), F.col("text")).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).where(F.col("line").rlike(f"[^{SPACE}]"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD_TOKEN, VARIABLE)).otherwise(F.col("line"))
    tokens = F.filter(F.split(masked, f"[{SPACE}]+"), lambda t: t != "")
    lines = lines.select("doc", "text_hash", "line_no", F.transform(tokens, lambda t: F.hash(t)).alias("tokens"))
    n = F.size("tokens")
    return lines.select(
        "doc",
        "text_hash",
        "line_no",
        n.alias("n"),
        F.xxhash64(n, F.slice("tokens", 1, DEPTH)).alias("leaf"),
        F.xxhash64("tokens", F.lit(1)).alias("line_hash"),
        "tokens",
    )


def _enough(agreed: Column, n: Column, similar: float) -> Column:
    """Whether so many equal tokens after the leading ones make a template of lines of ``n`` tokens."""
    tail = F.greatest(n - DEPTH, F.lit(0))
    return (F.least(n, F.lit(DEPTH)) + agreed >= F.lit(similar) * n) & (2 * agreed > tail)


def _field_sets(lengths: DataFrame, similar: float) -> DataFrame:
    """(n, fields): for each number of tokens, the smallest sets of fields that are enough, as bits."""
    tail = F.greatest(F.col("n") - DEPTH, F.lit(0))
    sets = lengths.withColumn("fields", F.explode(F.sequence(F.lit(0), F.lit(2**FIELDS - 1))))
    bit = lambda i: F.col("fields").bitwiseAND(1 << i) != 0
    size = lambda i: _cut(i + 1, tail) - _cut(i, tail)
    agreed = sum((F.when(bit(i), size(i)).otherwise(0) for i in range(FIELDS)), F.lit(0))
    smallest = _enough(agreed, F.col("n"), similar)
    for i in range(FIELDS):
        smallest = smallest & (~bit(i) | ~_enough(agreed - size(i), F.col("n"), similar))
    return sets.where(smallest)


def first_documents(lines: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(leaf, line_hash, to): distinct lines that are of one template with a line of an earlier document, and that one."""
    leaves = lines.groupBy("leaf").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high"))
    several = materialize(leaves.where("low <> high").select("leaf"))
    if several.count() <= LEAVES:
        several = F.broadcast(several)
    distinct = lines.join(several, "leaf").groupBy("leaf", "line_hash").agg(
        F.min(F.struct("doc", "line_no"))["doc"].alias("doc"), F.first("n").alias("n"), F.first("tokens").alias("tokens"),
    )
    tail = F.greatest(F.col("n") - DEPTH, F.lit(0))
    cells = F.transform(F.sequence(F.lit(0), F.lit(FIELDS - 1)), lambda i: F.hash(_field(i, tail)))
    # The ids are fixed by writing them.
    distinct = materialize(distinct.withColumns({"id": F.monotonically_increasing_id(), "cells": cells}))

    # Agreement with the earliest line of the leaf; nothing is earlier for the lines that agree.
    heads = distinct.groupBy("leaf").agg(F.min(F.struct("doc", "id", "tokens")).alias("head"), F.max("doc").alias("last"))
    heads = heads.where(F.col("head.doc") < F.col("last"))
    heads = materialize(heads.select("leaf", F.col("head.doc").alias("to"), F.col("head.tokens").alias("others")))
    met = distinct.join(heads, "leaf").where("to < doc")
    met = materialize(met.select("id", "leaf", "to", _same_template(similar).alias("agrees")))
    by_leaf = met.where("agrees").select("id", "to")
    several = materialize(met.where("not agrees").select("leaf").distinct())
    rest = materialize(distinct.join(several, "leaf", "left_semi"))

    # Agreement in whole fields.
    sets = materialize(_field_sets(rest.select("n").distinct(), similar))
    bit = lambda i: F.col("fields").bitwiseAND(1 << i) != 0
    key = F.xxhash64("leaf", "fields", *(F.when(bit(i), F.get("cells", F.lit(i))) for i in range(FIELDS)))
    keyed = rest.select("id", "leaf", "doc", "n", "cells").join(sets, "n")
    keyed = materialize(keyed.select("id", "doc", key.alias("key")))
    groups = keyed.groupBy("key").agg(F.min("doc").alias("to"), F.max("doc").alias("last"))
    groups = materialize(groups.where("to < last").select("key", "to"))
    by_fields = keyed.join(groups, "key").where("to < doc").groupBy("id").agg(F.min("to").alias("to"))
    found = materialize(_earliest(by_leaf.unionByName(by_fields)))

    first = _earliest(found.unionByName(_by_tokens(rest, found, similar)))
    return first.join(distinct.select("id", "leaf", "line_hash"), "id").select("leaf", "line_hash", "to")


def _earliest(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min("to").alias("to"))


def _same_template(similar: float) -> Column:
    """Whether lines of one leaf, ``tokens`` and ``others``, are of one template."""
    same = F.size(F.filter(F.zip_with("tokens", "others", lambda a, b: a == b), lambda x: x))
    n = F.size("tokens")
    return _enough(same - F.least(n, F.lit(DEPTH)), n, similar)


def _by_tokens(lines: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """(id, to): agreement token by token with the lines of an equal field, before the document found so far.

    In rounds: each round takes a few of the earliest lines of every field as heads, more in each. A line that agrees
    with a head has no use for later ones, so only lines without a template meet all earlier lines of their fields.
    """
    late, early = _sharing_lines(lines, found, similar)
    tokens = lines.select("id", "tokens")
    others = lines.select(F.col("id").alias("head"), F.col("tokens").alias("others"))
    result, wanted = found.limit(0), HEADS
    while not late.isEmpty():
        heads = early.groupBy("key", F.pmod(F.xxhash64("head"), F.lit(wanted)).alias("slot")).agg(
            F.min(F.struct("to", "head")).alias("first"), F.max("parts").alias("parts")
        )
        heads = materialize(heads.select("key", "first.to", "first.head", "parts"))
        dealt = heads.select("key", "to", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        part = F.pmod(F.xxhash64("id"), "parts").cast("int")
        pairs = late.select("key", "id", "until", part.alias("part")).join(dealt, ["key", "part"])
        pairs = materialize(pairs.where("to < until").select("id", "head", "to").distinct())
        met = pairs.join(tokens, "id").join(others, "head").where(_same_template(similar))
        agreed = materialize(_earliest(met.select("id", "to")))
        result = result.unionByName(agreed)

        late = late.join(agreed, "id", "left").select("key", "id", F.least("until", "to").alias("until"), "parts")
        early = early.join(heads.select("key", "head"), ["key", "head"], "left_anti")
        late, early = _open_fields(late, early)
        wanted *= MORE_HEADS
    return result


def _sharing_lines(lines: DataFrame, found: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(key, id, until, parts) and (key, head, to, parts): by equal field, lines that may be of the template of a line
    of a document before the one found, and these lines."""
    tail = F.greatest(F.col("n") - DEPTH, F.lit(0))
    # Rounding may only let more tokens differ here; pairs are compared exactly later.
    asked = F.greatest(F.ceil(F.lit(similar) * F.col("n") - 1e-6) - F.least(F.col("n"), F.lit(DEPTH)), F.floor(tail / 2) + 1)
    fields = (tail - asked + 1).cast("int")
    cell = lambda i: F.xxhash64("leaf", i, _field(i, tail, F.col("parts")))
    # Lines of one template that may not differ are one line.
    held = lines.withColumn("parts", fields).where("parts > 1")
    held = held.select("id", "doc", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell)).alias("key"))
    held = held.join(found, "id", "left").select("key", "id", "doc", F.least("doc", "to").alias("until"))
    crowds = held.groupBy("key").agg(F.min("doc").alias("low"), F.max("until").alias("high"), F.count("*").alias("size"))
    held = held.join(materialize(crowds.where("low < high")), "key").withColumn("parts", F.ceil(F.col("size") / CROWD).cast("int"))
    held = materialize(held.where("low < until or doc < high"))
    late = held.where("low < until").select("key", "id", "until", "parts")
    return late, held.where("doc < high").select("key", F.col("id").alias("head"), F.col("doc").alias("to"), "parts")


def _open_fields(late: DataFrame, early: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of both sides where a field holds a line before the document found so far."""
    late, early = materialize(late), materialize(early)
    low = early.groupBy("key").agg(F.min("to").alias("low"))
    high = late.groupBy("key").agg(F.max("until").alias("high"))
    bounds = materialize(low.join(high, "key").where("low < high"))
    late = late.join(bounds, "key").where("low < until").select("key", "id", "until", "parts")
    early = early.join(bounds, "key").where("to < high").select("key", "head", "to", "parts")
    return materialize(late), materialize(early)


def dropped_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per document and text: the numbers of the lines to drop."""
    lines = materialize(parse_lines(docs))
    near = materialize(first_documents(lines, similar))
    exact = lines.groupBy("leaf", "line_hash").agg(F.min("doc").alias("to"), F.max("doc").alias("last"))
    exact = exact.where("to <> last").select("leaf", "line_hash", "to").join(near, ["leaf", "line_hash"], "left_anti")
    recurring = materialize(exact.unionByName(near))
    return (
        lines.select("doc", "text_hash", "line_no", "leaf", "line_hash")
        .join(recurring, ["leaf", "line_hash"])
        .where("doc <> to")
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("line_no").alias("drop"))
    )


def _rewritten(docs: DataFrame, similar: float) -> DataFrame:
    """Every row packed, with its new text and its line counts."""
    drops = dropped_lines(docs.select("doc_id", "text"), similar)
    rows = docs.select(
        packed(docs).alias("row"),
        _key(docs[quoted("doc_id")], docs[quoted("text")]).alias("doc"),
        F.xxhash64(docs[quoted("text")]).alias("text_hash"),
    )
    rows = rows.join(drops, ["doc", "text_hash"], "left").select(
        "row", "drop", F.split(F.col("row")["text"], "\n").alias("lines")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    text = F.when(F.col("drop").isNull(), F.col("row")["text"]).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return rows.select(
        "row",
        text.alias("new_text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, the text without its recurring lines, and how many lines it had and lost."""
    return _rewritten(docs.select("doc_id", "text"), similar).select(
        F.col("row")["doc_id"].alias("doc_id"), F.col("new_text").alias("text"), "n_lines", "n_dropped"
    )


def without_recurring_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with all their columns, recurring lines removed (n_chars follows the text)."""
    return with_text(_rewritten(docs, similar), "row", "new_text", docs.columns)
