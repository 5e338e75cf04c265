"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``<|im_start|>role\ntext<|im_end|>\n``. The rendered
text is parsed again by the same grammar; if the turns found differ from the source, the
conversation is rendered with its conflicting content escaped and parsed once more, and
a difference after that is an error. Escaping puts one more backslash behind the ``<`` of
anything that looks like a control string, escaped or not, and doubles nothing else, so
it can always be undone. Texts without control strings are never changed.

Turns are ordered by turn number, then role and text. Cases: a NULL or empty role or text
is empty; rows without conv_id are one conversation; repeated rows are repeated turns; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<(\\*)\|im_(start|end)\|>"
ESCAPED = r"<\\(\\*)\|im_(start|end)\|>"
ANY_CONTROL = r"<\|im_(?:start|end)\|>"
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<$1\\|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<$1|im_$2|>")


def escape_role(role: Column) -> Column:
    """A role fills one line: backslashes and line ends are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Line ends are marked first by a character pair that no escaped role holds.
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _rendered(turns: Column, escaped: bool) -> Column:
    role = (lambda r: escape_role(r)) if escaped else (lambda r: r)
    body = (lambda t: escape(t)) if escaped else (lambda t: t)
    return F.array_join(
        F.transform(
            turns, lambda x: F.concat(F.lit(START), role(x["role"]), F.lit("\n"), body(x["text"]), F.lit(END + "\n"))
        ),
        "",
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: an array of (role, text)."""
    return F.transform(
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)),
        lambda x: F.struct(
            _unescape_role(F.regexp_extract(x, TURN, 1)).alias("role"),
            unescape(F.regexp_extract(x, TURN, 2)).alias("text"),
        ),
    )


def _spans(formatted: Column) -> Column:
    """Of each assistant turn: the place and length of its text in the formatted text."""
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    found = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda state, x: F.struct(
            (state["at"] + F.length(x)).alias("at"),
            F.when(
                F.regexp_extract(x, TURN, 1) == "assistant",
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.lit(len(START) + len("assistant") + 1)).alias("start"),
                            F.length(F.regexp_extract(x, TURN, 2)).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return found["spans"]


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, the formatted text and the spans that carry loss (assistant texts)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("x"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    chats = chats.select("conv_id", "turns", source.alias("source"), _rendered(F.col("turns"), False).alias("plain"))
    whole = lambda t: F.array_join(F.regexp_extract_all(t, F.lit(TURN), F.lit(0)), "")
    # Two control strings a turn and no more: none is left inside a text or a role.
    controls = lambda t: F.size(F.regexp_extract_all(t, F.lit(ANY_CONTROL), F.lit(0)))
    same = lambda t: (
        (parse(t) == F.col("source")) & (whole(t) == t) & (controls(t) == 2 * F.size("source"))
    )
    chats = chats.select(
        "conv_id",
        "source",
        F.when(same(F.col("plain")), F.col("plain")).otherwise(_rendered(F.col("turns"), True)).alias("formatted"),
    )
    return chats.select(
        "conv_id",
        F.when(same(F.col("formatted")), F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
        .alias("formatted"),
    ).select("conv_id", "formatted", _spans(F.col("formatted")).alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted texts and their loss spans."""
    chats = chats.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(
            F.transform(
                "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
            ),
            "",
        ).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
