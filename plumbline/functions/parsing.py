"""Text to number and text to timestamp, with bad values read as missing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DATE_PATTERNS


def parse_number(value: Column) -> Column:
    """Text as double; anything that is not a plain number is NULL.

    Spark also accepts Java type suffixes (``1d``, ``1f``), which are not numbers
    here, and reads ``nan`` as NaN, which means missing.
    """
    number = value.try_cast("double")
    suffixed = value.rlike(r"(?i)[0-9.][df]\s*$")
    return F.when(~suffixed & ~F.isnan(number), number)


def _shape(pattern: str) -> str:
    """The texts a date pattern can match, as a regular expression."""
    digits = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}"}
    digits |= {"HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
    names = {"MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}"}
    pieces = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']+", pattern)]
    known = digits | names
    return "^" + "".join(known.get(p, re.escape(p.strip("'"))) for p in pieces) + "$"


def parse_timestamp(value: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """Text as timestamp in the first pattern that reads it; no match is NULL.

    Each pattern is only tried on text of its shape: a failed parse costs an exception.
    """
    text = F.trim(value)
    tries = [F.when(text.rlike(_shape(p)), F.try_to_timestamp(text, F.lit(p))) for p in patterns]
    return F.coalesce(*tries).cast("timestamp_ntz")
