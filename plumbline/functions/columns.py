"""Column references, type families and batches of columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRINGS = (T.StringType, T.VarcharType, T.CharType)


def ref(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*INTEGERS, *FLOATS, T.DecimalType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIMES)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, STRINGS)


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in types_of(df).items() if is_numeric(t)]


def string_columns(df: DataFrame) -> list[str]:
    return [n for n, t in types_of(df).items() if is_string(t)]


def as_double(name: str) -> Column:
    """A numeric column as double with NaN read as missing."""
    value = ref(name).cast("double")
    return F.when(~F.isnan(value), value)


def batches(items: Iterable, size: int) -> Iterator[list]:
    items = list(items)
    for start in range(0, len(items), size):
        yield items[start : start + size]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def fresh(df: DataFrame, stem: str) -> str:
    """A helper column name that does not clash with the table's columns."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name
