"""Thresholds of every rule, in one frozen value."""

from __future__ import annotations

from dataclasses import dataclass

# Tokens a CSV cell may hold that mean "missing".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Date patterns tried in this order.
DATE_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MMM-yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)

# The query a column name becomes when context is looked up for it.
COLUMN_QUERY = "column {column} description valid range constraints meaning"


@dataclass(frozen=True)
class Thresholds:
    """Cut-off values of the statistical rules (fixed values)."""

    inference_sample: int = 100
    numeric_share: float = 0.8
    datetime_share: float = 0.8
    categorical_ratio: float = 0.05
    high_cardinality: int = 20
    top_values: int = 5
    sample_values: int = 5
    skew_symmetric: float = 0.5
    skew_moderate: float = 1.0
    drop_column_percent: float = 60.0
    high_null_percent: float = 20.0
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    outlier_drop_share: float = 0.02
    outlier_drop_min_rows: int = 100
    bars: int = 10
    heatmap_min_columns: int = 2
    kde_min_rows: int = 10
    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 3
    min_score: float = 0.3
    classification_max_distinct: int = 10
    balanced: float = 0.8
    slightly_imbalanced: float = 0.4
    imbalanced: float = 0.1
    correlation_min_rows: int = 10
    alpha: float = 0.05
    onehot_max: int = 10
    label_max: int = 50
    bins: int = 5
    bin_min_distinct: int = 20
    bin_min_range: float = 10.0
    standardize_factor: float = 10.0


DEFAULTS = Thresholds()

# Sizes that steer the physical plan; none of them changes a result.
WIDE_AGG_COLUMNS = 60  # columns aggregated in one pass, to stay inside codegen limits
DIRECT_QUANTILE_ROWS = 100_000  # up to here one value->count map per column is small
SKETCH_K = 8192  # accuracy of the sketch that brackets exact quantiles
FINE_SKETCH_K = 65535  # the same for large columns, where a narrower bracket saves a scan
FINE_SKETCH_ROWS = 50_000_000
ROWS_PER_RANGE = 250_000  # target rows of one range of an ordered operator
MAX_RANGES = 16_384  # ranges of an ordered operator; bounds every carry table
BROADCAST_ROWS = 100_000  # largest lookup that is broadcast, checked by a count
QUERY_BLOCK = 1024  # query vectors that are handed to all tasks, or scored at once in one
VECTOR_CELL = 8192  # vectors of either side that one task scores against each other
GRID_PARTS = 16  # parts of a side of the grid, as each vector is copied for all parts of the other side
LARGEST_CELL = 32_768  # vectors of a part from which on there are more parts instead
SCORE_BLOCK = 4_194_304  # scores that a task holds at once
