"""Column expressions shared by the operators that stay in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # the white space between words, as a regex class


def words(text: Column) -> Column:
    """The runs of non-space characters of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a regex class a text holds."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def packed(docs: DataFrame) -> Column:
    """The whole input row in one column, so that no added name can clash with it."""
    return F.struct(*(docs[quoted(c)] for c in docs.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*(F.col(row)[c].alias(c) for c in names))


def with_text(df: DataFrame, row: str, text: str, names: list[str]) -> DataFrame:
    """The rows of ``row`` with the text replaced; a column n_chars follows it."""
    new = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return df.select(*(new.get(c, F.col(row)[c]).alias(c) for c in names))
