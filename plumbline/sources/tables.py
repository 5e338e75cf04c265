"""Sources, sinks and whole-table views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NULL_TOKENS, WIDE_AGG_COLUMNS
from ..functions.columns import as_double, batches, is_string, ref, types_of
from ..functions.parsing import parse_number
from ..operators.profile import null_mask


def has_multiline_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes over a line end: then some line has an odd quote count."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).take(1))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """A CSV with header; null tokens become NULL, then columns get types.

    Without a schema a column becomes bigint, double or boolean when every value reads
    as such, else text. Files can only be split when no quoted cell holds a line end;
    ``multiline=None`` finds out with one scan, so ordinary files stay splittable.
    """
    if multiline is None:
        multiline = has_multiline_cells(spark, path)
    raw = spark.read.csv(path, header=True, multiLine=multiline, escape='"', quote='"')
    cells = normalize_nulls(raw)
    if schema is not None:
        if isinstance(schema, str):
            schema = spark.createDataFrame([], schema).schema
        return cells.select(
            *[_typed(ref(c), f.dataType).alias(f.name) for c, f in zip(cells.columns, schema.fields)]
        )
    return cells.select(
        *[_typed(ref(c), t).alias(c) for c, t in infer_types(cells).items()]
    )


def _typed(cell: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DoubleType):
        return parse_number(cell)
    return cell if is_string(dtype) else F.trim(cell).try_cast(dtype)


def infer_types(cells: DataFrame) -> dict[str, T.DataType]:
    """Type of each text column from all of its values, in one aggregate pass."""
    kinds: dict[str, T.DataType] = {}
    for group in batches(cells.columns, WIDE_AGG_COLUMNS):
        aggs = []
        for i, c in enumerate(group):
            v = F.trim(ref(c))
            whole = v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.count_if(whole).alias(f"w{i}"),
                F.count_if(parse_number(v).isNotNull()).alias(f"d{i}"),
                F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
            ]
        row = cells.agg(*aggs).first()
        for i, c in enumerate(group):
            n = row[f"n{i}"]
            if n and row[f"w{i}"] == n:
                kinds[c] = T.LongType()
            elif n == row[f"d{i}"]:  # a column without values is numeric and empty
                kinds[c] = T.DoubleType()
            elif row[f"b{i}"] == n:
                kinds[c] = T.BooleanType()
            else:
                kinds[c] = T.StringType()
    return kinds


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file with header per task under ``path``; NULL is an empty cell."""
    df.write.mode(mode).csv(path, header=True, escape='"', quote='"', nullValue="", emptyValue='""')


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``, one row per file; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Null tokens in text and NaN in numbers become NULL."""
    columns = []
    for name, dtype in types_of(df).items():
        value = ref(name)
        if is_string(dtype):
            value = F.when(~value.isin(*NULL_TOKENS), value)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        columns.append(value.alias(name))
    return df.select(*columns) if columns else df


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """The first rows in a named order."""
    return df.orderBy(*[ref(c) for c in order_by]).limit(n)


def compare(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows, columns and missing cells before and after cleaning."""

    def side(df: DataFrame, version: str) -> DataFrame:
        missing = F.lit(0).cast("bigint")
        for c in df.columns:
            missing = missing + F.count_if(null_mask(df, c))
        return df.agg(F.count("*").alias("rows"), missing.alias("nulls")).select(
            F.lit(version).alias("version"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            "nulls",
        )

    return side(raw, "raw").unionByName(side(cleaned, "cleaned"))
