"""Text chunks, vectors and exact top-k retrieval."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COLUMN_QUERY, DEFAULTS, GRID_PARTS, LARGEST_CELL, QUERY_BLOCK, SCORE_BLOCK, VECTOR_CELL, Thresholds
from ..functions.columns import ref, types_of
from ..session import materialize


def chunks(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Overlapping chunks ``(keep..., chunk_id, start, text)`` of whole texts.

    A chunk starts every size - overlap characters, up to the end of the text, so the
    last one may repeat nothing but overlap. Empty texts give no rows.
    """
    step = limits.chunk_size - limits.chunk_overlap
    # Cut once into pieces of one step, then complete each with the pieces after it:
    # taking substrings from the start of a long text again and again is quadratic.
    more = math.ceil(limits.chunk_overlap / step)
    pieces = F.regexp_extract_all(ref(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    whole = F.transform(
        F.col("_pieces"),
        lambda _, i: F.substring(
            F.array_join(F.slice("_pieces", i + 1, more + 1), ""), 1, limits.chunk_size
        ),
    )
    return (
        docs.filter(F.length(ref(text)) > 0)
        .select(*[ref(c) for c in keep], pieces.alias("_pieces"))
        .select(*[ref(c) for c in keep], F.posexplode(whole).alias("chunk_id", "text"))
        .select(*[ref(c) for c in keep], "chunk_id", (F.col("chunk_id") * step).alias("start"), "text")
    )


WORD_BREAK = r"[^\p{L}\p{N}_]+"


def _feature(word: str, features: int) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % features


class TextVectors:
    """Hashed, document-frequency weighted, L2-normalised word vectors.

    A word is the feature that the first digits of its MD5 name. One weight per feature is learned
    from the corpus in one aggregation; every text is then turned into its vector where it is,
    without a shuffle. Texts are cut into words once if they come from ``featured``.
    """

    def __init__(self, features: int = 256):
        self.features = features
        self.weights: np.ndarray | None = None

    def featured(self, rows: DataFrame) -> DataFrame:
        """Add ``_features``, the feature of every word; rows with blank text are left out."""
        features, schema = self.features, T.StructType([*rows.schema.fields]).add("_features", T.ArrayType(T.IntegerType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(batch.num_columns - 1)
                # The words of these rows only, each distinct one hashed once.
                named = words.flatten().dictionary_encode()
                code = np.array([_feature(w, features) for w in named.dictionary.to_pylist()], np.int32)
                found = code[named.indices.to_numpy()] if len(code) else np.zeros(0, np.int32)
                sizes = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "_features"])

        words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
        cut = rows.filter(F.trim("text") != "").select(*[ref(c) for c in rows.columns], words.alias("_features"))
        return cut.mapInArrow(run, schema)

    def fit(self, corpus: DataFrame) -> TextVectors:
        return self.fit_featured(self.featured(corpus))

    def fit_featured(self, rows: DataFrame) -> TextVectors:
        """Learn the weights; one count per feature reaches the driver."""
        marked = F.explode(F.array_append(F.array_distinct("_features"), F.lit(-1)))  # -1 stands for the text itself
        counts = {r["f"]: r["n"] for r in rows.select(marked.alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}
        texts = counts.get(-1, 0)
        self.weights = np.array([math.log((texts + 1) / (counts.get(f, 0) + 1)) for f in range(self.features)])
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``vector``; rows with blank text are left out."""
        return self.transform_featured(self.featured(rows))

    def transform_featured(self, rows: DataFrame) -> DataFrame:
        weights, width = self.weights, self.features
        kept = [f for f in rows.schema.fields if f.name != "_features"]
        schema = T.StructType([*kept]).add("vector", T.ArrayType(T.FloatType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("_features")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                at = row * width + lists.flatten().to_numpy()
                matrix = np.bincount(at, minlength=batch.num_rows * width).reshape(-1, width) * weights
                flat = pa.array(_unit(matrix).astype(np.float32).ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), flat)
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), vectors], [*names, "vector"])

        return rows.select(*[ref(f.name) for f in kept], "_features").mapInArrow(run, schema)


def embed_chunks(corpus: DataFrame, features: int = 256) -> DataFrame:
    """Chunks with their vectors; the chunks are cut into words once."""
    vectors = TextVectors(features)
    rows = materialize(vectors.featured(corpus))
    return vectors.fit_featured(rows).transform_featured(rows)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _unit_rows(vectors) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _best(candidates: pd.DataFrame, ids: list[str], k: int) -> pd.DataFrame:
    order = candidates.sort_values(
        ["query_id", "score", *ids], ascending=[True, False, *[True] * len(ids)], kind="stable"
    )
    return order.groupby("query_id", sort=False).head(k)


def _floors(block: np.ndarray, k: int) -> np.ndarray:
    """A score for each query that its ``k`` best reach: the k-th of the best of stretches."""
    if block.shape[1] <= k:
        return np.full(len(block), -np.inf)
    best = np.maximum.reduceat(block, np.arange(0, block.shape[1], max(1, block.shape[1] // (16 * k))), axis=1)
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] - 1e-9  # more than rounding moves


def _parts(rows: int, cell: int) -> int:
    """Parts of one side of the grid: GRID_PARTS at most, until a part has LARGEST_CELL vectors."""
    return max(1, math.ceil(rows / max(cell, min(LARGEST_CELL, math.ceil(rows / GRID_PARTS)))))


def _nearest(part: pd.DataFrame, names: Sequence, units: np.ndarray, kept: list[str], ids: list[str], k: int) -> pd.DataFrame:
    """At most ``k`` rows of ``part`` for each query; equal scores take the smaller ids."""
    part = part.sort_values(ids, kind="stable", ignore_index=True)
    corpus, rows, columns, scores = _unit_rows(part["vector"]), [], [], []
    step = max(1, min(QUERY_BLOCK, SCORE_BLOCK // len(part)))
    for at in range(0, len(names), step):
        block = units[at : at + step] @ corpus.T
        column, row = np.nonzero(block >= _floors(block, k)[:, None])
        score = np.round(block[column, row], 10)  # equal vectors score alike
        order = np.lexsort((row, -score, column))
        picks = order[np.arange(len(order)) - np.searchsorted(column, column) < k]
        rows.append(row[picks])
        columns.append(column[picks] + at)
        scores.append(score[picks])
    found = part[kept].iloc[np.concatenate(rows)].reset_index(drop=True)
    found.insert(0, "score", np.concatenate(scores))
    found.insert(0, "query_id", pd.Series(names, dtype=object).iloc[np.concatenate(columns)].to_numpy())
    return found


def top_matches(
    corpus: DataFrame,
    queries: DataFrame,
    ids: Sequence[str],
    k: int = DEFAULTS.top_k,
    min_score: float | None = DEFAULTS.min_score,
    payload: Sequence[str] = (),
    block: int = QUERY_BLOCK,
    cell: int = VECTOR_CELL,
) -> DataFrame:
    """``(query_id, rank, ids..., payload..., score)``: the k nearest rows by cosine.

    Up to ``block`` queries, by a count, are handed to all tasks: every corpus row is scored where it
    lies, and no vector is shuffled. More queries meet the corpus on a grid: both sides are
    dealt into parts of about ``cell`` vectors, of more where there would be many parts, and each part of the queries is scored against each part
    of the corpus in a task of its own, which keeps k rows a query. Either way only those are merged.
    The score floor applies after the top k, as part of the result. Scores are compared to ten digits; of
    equal ones the smaller ids are nearer.
    """
    ids, payload = list(ids), list(payload)
    types = types_of(corpus)
    kept = [*ids, *payload]
    query_type = types_of(queries)["query_id"].simpleString()
    schema = f"query_id {query_type}, score double, " + ", ".join(
        f"`{c}` {types[c].simpleString()}" for c in kept
    )
    rows = corpus.filter(F.col("vector").isNotNull()).select(*[ref(c) for c in kept], "vector")
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
    few = asked.limit(block + 1).collect()
    if len(few) <= block:
        found = _scored_in_place(rows, few, kept, ids, k, schema)
    else:
        found = _scored_on_grid(rows, asked, kept, ids, k, cell, schema)
    # At most k rows per query and task, or part of the corpus, arrive here.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), *[ref(c) for c in ids])
    ranked = found.withColumn("rank", F.row_number().over(order))
    wanted = F.col("rank") <= k
    if min_score is not None:
        wanted = wanted & (F.col("score") > min_score)
    return ranked.filter(wanted).select("query_id", "rank", *[ref(c) for c in kept], "score")


def _scored_in_place(rows: DataFrame, few: list, kept: list[str], ids: list[str], k: int, schema: str) -> DataFrame:
    spark = rows.sparkSession
    if not few:
        return spark.createDataFrame([], schema)
    names, units = [r["query_id"] for r in few], _unit_rows([r["vector"] for r in few])
    shared = spark.sparkContext.broadcast((names, units))  # at most one block of vectors

    def best_of_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, units = shared.value
        best = None
        for part in parts:
            if part.empty:
                continue
            found = _nearest(part, names, units, kept, ids, k)
            best = found if best is None else _best(pd.concat([best, found], ignore_index=True), ids, k)
        if best is not None:
            yield best[["query_id", "score", *kept]]

    return rows.mapInPandas(best_of_task, schema)


def _scored_on_grid(
    rows: DataFrame, asked: DataFrame, kept: list[str], ids: list[str], k: int, cell: int, schema: str
) -> DataFrame:
    """Each part of the corpus against each part of the queries, in a task that holds one of both."""
    rows, asked = materialize(rows), materialize(asked)
    across, down = (_parts(side.count(), cell) for side in (rows, asked))

    def dealt(side: DataFrame, parts: int, others: int, mine: str, other: str) -> DataFrame:
        # Repeated rows are dealt apart too.
        own = F.pmod(F.xxhash64(*[ref(c) for c in side.columns if c != "vector"], F.monotonically_increasing_id()), F.lit(parts))
        spread = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return side.withColumn(mine, own.cast("int")).withColumn(other, spread)

    corpus = dealt(rows, across, down, "_column", "_row").groupBy("_column", "_row")
    queries = dealt(asked, down, across, "_row", "_column").groupBy("_column", "_row")

    def best_of_cell(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if part.empty or block.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "score", *kept)})
        found = _nearest(part, block["query_id"].tolist(), _unit_rows(block["vector"]), kept, ids, k)
        return found[["query_id", "score", *kept]]

    return corpus.cogroup(queries).applyInPandas(best_of_cell, schema)


def join_context(matches: DataFrame) -> DataFrame:
    """``(query_id, context)``: matched texts in rank order, a blank line between them."""
    texts = F.array_sort(F.collect_list(F.struct("rank", "text")))["text"]
    return matches.groupBy("query_id").agg(F.array_join(texts, "\n\n").alias("context"))


def context_for_columns(
    spark: SparkSession,
    columns: Sequence[str],
    corpus: DataFrame,
    ids: Sequence[str] = ("doc_id", "chunk_id"),
    vectors: TextVectors | None = None,
    limits: Thresholds = DEFAULTS,
    template: str = COLUMN_QUERY,
) -> DataFrame:
    """Context per column name from a corpus of chunks; columns without a match are absent."""
    if vectors is None:
        vectors = TextVectors()
        featured = materialize(vectors.featured(corpus))
        found = vectors.fit_featured(featured).transform_featured(featured)
    else:
        found = vectors.transform(corpus)
    asked = spark.createDataFrame(
        [(c, template.format(column=c)) for c in columns], "query_id string, text string"
    )
    matches = top_matches(
        found,
        vectors.transform(asked).select("query_id", "vector"),
        ids,
        limits.top_k,
        limits.min_score,
        payload=["text"],
    )
    return join_context(matches)
