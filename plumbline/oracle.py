"""The registered queries in SQL, for a comparison on another engine.

Each text is written from the definition of the operator, not from the Spark code.
"""

from __future__ import annotations

from .config import DATE_PATTERNS
from .views import EVENTS_DIRTY, ORDERS_DIRTY

ORDERS = f"orders_dirty AS ({ORDERS_DIRTY})"
EVENTS = f"events_dirty AS ({EVENTS_DIRTY})"

# column -> kind of the dirty orders, in table order
ORDER_COLUMNS = {
    "o_orderkey": "number",
    "o_totalprice": "number",
    "o_orderdate": "date",
    "o_orderpriority": "text",
    "custkey_str": "text",
    "date_str": "text",
    "mostly_null": "number",
}

_PYTHON_DATES = {
    "yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "d": "%-d",
    "HH": "%H", "mm": "%M", "ss": "%S",
}


def _strptime(pattern: str) -> str:
    text = pattern.replace("'", "")
    for token in ("yyyy", "MMMM", "MMM", "MM", "dd", "HH", "mm", "ss"):
        text = text.replace(token, f"<{token}>")
    for token, code in _PYTHON_DATES.items():
        text = text.replace(f"<{token}>", code)
    return text.replace(" d", " %-d")


FORMATS = "[" + ", ".join(f"'{_strptime(p)}'" for p in DATE_PATTERNS) + "]"


def as_date(x: str) -> str:
    return f"try_strptime({x}, {FORMATS})"


def label(skew: str) -> str:
    return (
        f"CASE WHEN abs({skew}) < 0.5 THEN 'symmetric' WHEN abs({skew}) < 1.0 THEN 'moderate_skew' "
        "ELSE 'high_skew' END"
    )


def fence(view: str, x: str) -> str:
    """One row (lo, hi, q1, med, q3)."""
    return (
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q1, med, q3 FROM "
        f"(SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 "
        f"FROM (SELECT CAST({x} AS DOUBLE) AS x FROM {view})))"
    )


def numeric(view: str, name: str, x: str) -> str:
    return f"""SELECT '{name}' AS "column", CAST(count(*) - count(x) AS BIGINT) AS null_count,
  round(100.0 * (count(*) - count(x)) / count(*), 2) AS null_percent,
  round(avg(x), 4) AS mean, round(min(med), 4) AS median, round(stddev_samp(x), 4) AS std,
  round(min(x), 4) AS min, round(max(x), 4) AS max,
  round(coalesce(skewness(x), 0.0), 4) + 0.0 AS skewness,
  {label("round(coalesce(skewness(x), 0.0), 4)")} AS skew_label,
  CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS outlier_count
FROM (SELECT CAST({x} AS DOUBLE) AS x FROM {view}), {fence(view, x)}"""


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def kinds(view: str = "orders_dirty") -> str:
    """type_category of each text column from its first 100 values."""
    parts = []
    for c, kind in ORDER_COLUMNS.items():
        if kind == "text":
            parts.append(
                f"""SELECT '{c}' AS "column", CASE
  WHEN avg(CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'should_be_numeric'
  WHEN avg(CASE WHEN {as_date("v")} IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'should_be_datetime'
  ELSE 'categorical' END AS type_category
FROM (SELECT {c} AS v FROM {view} WHERE {c} IS NOT NULL ORDER BY o_orderkey, date_str LIMIT 100)"""
            )
        else:
            category = {"number": "numeric", "date": "datetime"}[kind]
            parts.append(f"""SELECT '{c}' AS "column", '{category}' AS type_category""")
    return union(parts)


def profile(view: str = "orders_dirty") -> str:
    """The scalar part of the column profile of the dirty orders."""
    parts = []
    for at, (c, kind) in enumerate(ORDER_COLUMNS.items()):
        x = c if kind == "number" else f"try_cast({c} AS DOUBLE)" if kind == "text" else "NULL"
        day = c if kind == "date" else as_date(c) if kind == "text" else "CAST(NULL AS TIMESTAMP)"
        parts.append(
            f"""SELECT {at} AS pos, s."column", s.null_count, s.null_percent, mean, median, std, min, max, skewness,
  skew_label, outlier_count, first_day, last_day, uniques, nulls, percent FROM ({numeric(view, c, x)}) s,
  (SELECT min({day}) AS first_day, max({day}) AS last_day, count(DISTINCT {c}) AS uniques,
    CAST(count(*) - count({c}) AS BIGINT) AS nulls,
    round(100.0 * (count(*) - count({c})) / count(*), 2) AS percent FROM {view})"""
        )
    is_number = "k.type_category IN ('numeric', 'should_be_numeric')"
    is_date = "k.type_category IN ('datetime', 'should_be_datetime')"
    plain = "k.type_category = 'numeric'"
    return f"""SELECT p.pos, p."column", k.type_category, p.nulls AS null_count, p.percent AS null_percent,
  CAST(p.uniques AS BIGINT) AS unique_count,
  CASE WHEN {is_number} THEN mean END AS mean, CASE WHEN {is_number} THEN median END AS median,
  CASE WHEN {plain} THEN std END AS std, CASE WHEN {plain} THEN min END AS min,
  CASE WHEN {plain} THEN max END AS max, CASE WHEN {is_number} THEN skewness END AS skewness,
  CASE WHEN {is_number} THEN skew_label END AS skew_label,
  CASE WHEN {is_number} THEN outlier_count END AS outlier_count,
  CASE WHEN {is_date} THEN first_day END AS min_date, CASE WHEN {is_date} THEN last_day END AS max_date,
  CASE WHEN k.type_category = 'categorical' THEN CASE WHEN uniques > 20 THEN 'high' ELSE 'low' END END AS cardinality
FROM ({union(parts)}) p JOIN kinds k ON p."column" = k."column" """


PROFILE = f"{ORDERS}, kinds AS ({kinds()}), prof AS ({profile()})"

PLAN = f"""{PROFILE}, steps AS (
  SELECT 0 AS s, 0 AS pos, 'duplicates' AS stage, CAST(NULL AS VARCHAR) AS "column", 'drop_duplicates' AS action
    WHERE (SELECT count(*) FROM orders_dirty) > (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty))
  UNION ALL SELECT 1, 0, 'names', NULL, 'standardize'
  UNION ALL SELECT 2, pos, 'types', "column", type_category FROM prof WHERE type_category LIKE 'should_be_%'
  UNION ALL SELECT 3, pos, 'nulls', "column", CASE WHEN null_percent > 60 THEN 'drop_column'
      WHEN type_category IN ('numeric', 'should_be_numeric') THEN
        CASE WHEN skew_label IN ('moderate_skew', 'high_skew') THEN 'fill_median' ELSE 'fill_mean' END
      WHEN type_category IN ('datetime', 'should_be_datetime') THEN 'fill_forward' ELSE 'fill_mode' END
    FROM prof WHERE null_percent > 0
  UNION ALL SELECT 4, pos, 'outliers', "column", CASE WHEN
      outlier_count / (SELECT CAST(count(*) AS DOUBLE) FROM orders_dirty) < 0.02
      AND (SELECT count(*) FROM orders_dirty) > 100 THEN 'drop' ELSE 'cap' END
    FROM prof WHERE outlier_count > 0)"""

UNIQUE = f"{ORDERS}, base AS (SELECT DISTINCT * FROM orders_dirty)"


def mode(view: str, x: str) -> str:
    return (
        f"(SELECT {x} FROM {view} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)"
    )


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

CLEANED = f"""{UNIQUE}, filled AS (
  SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM base)) AS o_totalprice,
    last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey {UPTO}) AS o_orderdate,
    coalesce(o_orderpriority, {mode("base", "o_orderpriority")}) AS o_orderpriority,
    try_cast(custkey_str AS DOUBLE) AS custkey_str, {as_date("date_str")} AS date_str
  FROM base)"""


def top_n(view: str, columns: list[str], k: int) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS position,
  {c} AS value, count(*) AS "count" FROM {view} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns
    ]
    return f"SELECT * FROM ({union(parts)}) WHERE position <= {k}"


def correlations(view: str, target: str, features: list[str]) -> str:
    """Pearson r, and its p-value by numerical integration of the t density (Simpson)."""
    parts = [
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NOT NULL AND {target} IS NOT NULL) AS pairs,
  corr({c}, {target}) AS r FROM {view}"""
        for c in features
    ]
    density = (
        "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) "
        "- (v + 1) / 2 * ln(1 + (t * i / 2000.0) * (t * i / 2000.0) / v))"
    )
    return f"""WITH c AS ({union(parts)}),
t AS (SELECT "column", pairs, r, CAST(pairs - 2 AS DOUBLE) AS v,
  least(abs(r) * sqrt((pairs - 2) / (1 - r * r)), 40.0) AS t FROM c),
area AS (SELECT "column", sum({density} * t / 6000.0 *
    CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS a
  FROM t, range(0, 2001) AS g(i) GROUP BY "column")
SELECT t."column", CAST(pairs AS BIGINT) AS pairs, round(r, 4) + 0.0 AS correlation,
  round(greatest(1 - 2 * a, 0.0), 4) AS p_value, 1 - 2 * a < 0.05 AS significant
FROM t JOIN area ON t."column" = area."column" """


def suggestions(view: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        if kind == "number":
            parts += [
                f"""SELECT '{c}' AS "column", 'log1p transform' AS suggestion FROM {view}
  HAVING abs(skewness({c})) > 1 AND min({c}) >= 0""",
                f"""SELECT '{c}', 'binning' FROM {view}
  HAVING count(DISTINCT {c}) > 20 AND max({c}) - min({c}) > 10""",
                f"""SELECT '{c}', 'standardize' FROM {view}
  HAVING avg({c}) <> 0 AND stddev_samp({c}) > 10 * avg({c})""",
            ]
        elif kind == "text":
            parts.append(
                f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 10 THEN 'one-hot encoding'
  WHEN count(DISTINCT {c}) <= 50 THEN 'label encoding or target encoding' ELSE 'consider dropping' END FROM {view}"""
            )
    first, *rest = parts
    named = f'SELECT "column", suggestion FROM ({first}) f("column", suggestion)'
    return union([named, *rest])


def bins(view: str, c: str, n: int) -> str:
    return f"""SELECT '{c}' AS "column",
  least(CAST(floor((x - lo) / w) AS BIGINT), {n - 1}) AS bin, lo, w, count(*) AS "count"
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {view} WHERE {c} IS NOT NULL),
  (SELECT CAST(min({c}) AS DOUBLE) AS lo, (CAST(max({c}) AS DOUBLE) - min({c})) / {n} AS w FROM {view})
GROUP BY bin, lo, w"""


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER_NUMBERS = [c for c, kind in ORDER_COLUMNS.items() if kind == "number"]


def _whisker(view: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(min(q1), 4) AS q1, round(min(med), 4) AS median,
  round(min(q3), 4) AS q3, round(min(x) FILTER (WHERE x >= lo AND x <= hi), 4) AS lower_whisker,
  round(max(x) FILTER (WHERE x >= lo AND x <= hi), 4) AS upper_whisker,
  CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS outlier_count
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {view}), {fence(view, c)}"""


def all_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    q = sql.__setitem__
    od, ev = f"WITH {ORDERS} ", f"WITH {EVENTS} "

    q("table_profile", od + """SELECT count(*) AS "rows", CAST(7 AS BIGINT) AS "columns",
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS duplicate_rows FROM orders_dirty""")
    q("null_profile", od + union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_percent FROM orders_dirty""" for c in ORDER_COLUMNS]))
    q("profile_numeric", od + union([numeric("orders_dirty", c, c) for c in ORDER_NUMBERS]))
    q("profile_lineitem", union([numeric("lineitem", c, c) for c in LINE_NUMBERS]))
    q("profile_unique", od + union([
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM orders_dirty""" for c in ORDER_COLUMNS]))
    q("profile_samples", od + "SELECT * FROM (" + union([
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY o_orderkey, date_str) AS position,
  CAST({c} AS VARCHAR) AS value FROM orders_dirty WHERE {c} IS NOT NULL"""
        for c in ["o_orderkey", "o_totalprice", "mostly_null", "o_orderpriority", "custkey_str"]])
      + ") WHERE position <= 5")
    q("profile_dates", f"""WITH {PROFILE} SELECT "column", type_category, min_date, max_date FROM prof
WHERE min_date IS NOT NULL""")
    q("infer_types", f"""WITH {ORDERS}, kinds AS ({kinds()})
SELECT "column", type_category AS issue FROM kinds WHERE type_category LIKE 'should_be_%'
UNION ALL SELECT 'o_orderpriority', 'should_be_categorical' FROM orders_dirty
  HAVING count(DISTINCT o_orderpriority) / count(*) < 0.05""")
    q("profile_converted", od + f"""SELECT "column", mean, median, skewness, skew_label, outlier_count
FROM ({numeric("orders_dirty", "custkey_str", "try_cast(custkey_str AS DOUBLE)")})""")
    q("top_values_by_column", od + top_n("orders_dirty", ["o_orderpriority", "custkey_str", "date_str"], 5))
    q("column_profile", f"WITH {PROFILE} SELECT * EXCLUDE (pos) FROM prof")
    q("summary_flags", f"""WITH {PROFILE} SELECT
  coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE null_percent > 20), '') AS high_null_columns,
  coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE skew_label = 'high_skew'), '') AS high_skew_columns,
  coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE outlier_count > 0), '') AS outlier_columns
FROM prof""")
    q("merged_profile", union([
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS null_count,
  round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_percent, round(avg({c}), 4) AS mean,
  round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
  round(skewness({c}), 4) + 0.0 AS skewness, {label(f"round(skewness({c}), 4)")} AS skew_label FROM lineitem"""
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]]))
    q("merged_top_values", top_n("lineitem", ["l_returnflag", "l_linestatus"], 5))

    q("drop_duplicates", od + "SELECT DISTINCT * FROM orders_dirty")
    q("standardize_names", """SELECT c_custkey AS cust_key, c_name AS cust_name, c_nationkey AS nation_key,
  c_acctbal AS acct_bal_, c_mktsegment AS mktsegment FROM customer""")
    q("to_numeric", od + "SELECT o_orderkey, try_cast(custkey_str AS DOUBLE) AS custkey_str FROM orders_dirty")
    q("to_datetime", od + f"SELECT o_orderkey, {as_date('date_str')} AS date_str FROM orders_dirty")
    codes = "CASE WHEN o_orderpriority IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) END"
    q("to_categorical", od + f"SELECT o_orderkey, o_orderpriority, {codes} AS o_orderpriority_code FROM orders_dirty")
    q("type_fixes", od + f"""SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority,
  try_cast(custkey_str AS DOUBLE) AS custkey_str, {as_date("date_str")} AS date_str, mostly_null,
  {codes} AS o_orderpriority_code FROM orders_dirty""")

    q("null_strategy", f"""WITH {PROFILE} SELECT "column", CASE WHEN null_percent > 60 THEN 'drop_column'
  WHEN type_category = 'numeric' AND skew_label IN ('moderate_skew', 'high_skew') THEN 'fill_median'
  WHEN type_category = 'numeric' THEN 'fill_mean' WHEN type_category = 'categorical' THEN 'fill_mode'
  WHEN type_category = 'datetime' THEN 'fill_forward' ELSE 'drop_rows' END AS strategy FROM prof""")
    q("fill_mean", od + """SELECT * REPLACE (round(coalesce(o_totalprice,
  (SELECT avg(o_totalprice) FROM orders_dirty)), 4) AS o_totalprice) FROM orders_dirty""")
    q("fill_median", od + """SELECT * REPLACE (round(coalesce(o_totalprice,
  (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)), 4) AS o_totalprice) FROM orders_dirty""")
    q("fill_mode", od + f"""SELECT * REPLACE (coalesce(o_orderpriority,
  {mode("orders_dirty", "o_orderpriority")}) AS o_orderpriority) FROM orders_dirty""")
    q("fill_forward", ev + f"""SELECT * REPLACE (last_value(value IGNORE NULLS)
  OVER (ORDER BY ts, event_id {UPTO}) AS value) FROM events_dirty""")
    q("fill_forward_by_user", ev + f"""SELECT * REPLACE (last_value(value IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id {UPTO}) AS value) FROM events_dirty""")
    q("drop_column", od + "SELECT * EXCLUDE (mostly_null) FROM orders_dirty")
    q("drop_null_rows", od + "SELECT * FROM orders_dirty WHERE o_totalprice IS NOT NULL")
    q("auto_nulls", f"""WITH {UNIQUE} SELECT o_orderkey, round(coalesce(o_totalprice,
    (SELECT quantile_cont(o_totalprice, 0.5) FROM base)), 4) AS o_totalprice,
  last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey {UPTO}) AS o_orderdate,
  coalesce(o_orderpriority, {mode("base", "o_orderpriority")}) AS o_orderpriority, custkey_str, date_str FROM base""")
    q("planned_nulls", f"""WITH {UNIQUE}, kept AS (SELECT * FROM base WHERE o_totalprice IS NOT NULL)
SELECT * REPLACE (coalesce(o_orderpriority, {mode("kept", "o_orderpriority")}) AS o_orderpriority,
  round(coalesce(mostly_null, (SELECT avg(mostly_null) FROM kept)), 4) AS mostly_null) FROM kept""")

    price = fence("orders_dirty", "o_totalprice")
    q("outliers_iqr", od + f"""SELECT o_orderkey, o_totalprice,
  coalesce(o_totalprice < lo OR o_totalprice > hi, false) AS is_outlier FROM orders_dirty, {price}""")
    q("outliers_zscore", od + """SELECT o_orderkey, o_totalprice,
  coalesce(abs((o_totalprice - m) / s) > 3.0, false) AS is_outlier FROM orders_dirty,
  (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders_dirty)""")
    capped = "CASE WHEN o_totalprice IS NOT NULL THEN round(least(greatest(o_totalprice, lo), hi), 4) END"
    cap = od + f"""SELECT d.* REPLACE ({capped} AS o_totalprice) FROM orders_dirty d, {price} f"""
    q("cap_outliers", cap)
    q("drop_outliers", od + f"""SELECT d.* FROM orders_dirty d, {price} f
WHERE NOT coalesce(o_totalprice < lo OR o_totalprice > hi, false)""")
    q("auto_outliers", cap)
    q("planned_outliers", ev[:-1] + f""", kept AS (SELECT d.* FROM events_dirty d, {fence("events_dirty", "value")} f
  WHERE NOT coalesce(value < lo OR value > hi, false))
SELECT d.* REPLACE (round(least(greatest(CAST(user_id AS DOUBLE), lo), hi), 4) AS user_id)
FROM kept d, {fence("kept", "user_id")} f""")
    q("outlier_strategy", f"""WITH {PROFILE} SELECT "column", outlier_count, CASE WHEN
    outlier_count / (SELECT CAST(count(*) AS DOUBLE) FROM orders_dirty) < 0.02
    AND (SELECT count(*) FROM orders_dirty) > 100 THEN 'drop' ELSE 'cap' END AS strategy
FROM prof WHERE outlier_count > 0""")

    q("cleaning_plan", f"""WITH {PLAN}
SELECT row_number() OVER (ORDER BY s, pos) - 1 AS seq, stage, "column", action FROM steps""")
    q("plan_warnings", f"""WITH {PLAN} SELECT stage, "column", 'column does not exist' AS problem FROM steps
WHERE "column" IS NOT NULL AND "column" NOT IN (SELECT column_name FROM (DESCRIBE orders))""")
    q("plan_overrides", f"""WITH {PLAN} SELECT "column", CASE "column" WHEN 'o_totalprice' THEN 'fill_mean'
  WHEN 'o_orderkey' THEN 'drop_rows' ELSE action END AS action FROM steps WHERE stage = 'nulls'""")
    q("plan_remapped", f"""WITH {PLAN} SELECT stage, replace("column", 'o_totalprice', 'total_price_') AS "column",
  action FROM steps WHERE "column" IS NOT NULL""")
    q("clean_orders", f"""WITH {CLEANED} SELECT d.* REPLACE (round(o_totalprice, 4) AS o_totalprice)
FROM filled d, {fence("filled", "o_totalprice")} f WHERE o_totalprice >= lo AND o_totalprice <= hi""")
    q("cleaning_log", f"""WITH {CLEANED}
SELECT 'duplicates' AS stage, NULL AS "column", 'drop_duplicates' AS action,
  (SELECT count(*) FROM orders_dirty) - (SELECT count(*) FROM base) AS rows_affected
UNION ALL SELECT 'nulls', 'o_totalprice', 'fill_median', count(*) - count(o_totalprice) FROM base
UNION ALL SELECT 'nulls', 'o_orderdate', 'fill_forward', count(*) - count(o_orderdate) FROM base
UNION ALL SELECT 'nulls', 'o_orderpriority', 'fill_mode', count(*) - count(o_orderpriority) FROM base
UNION ALL SELECT 'nulls', 'mostly_null', 'drop_column', count(*) - count(mostly_null) FROM base
UNION ALL SELECT 'outliers', 'o_totalprice', 'drop', count(*)
  FROM filled, {fence("filled", "o_totalprice")} WHERE o_totalprice < lo OR o_totalprice > hi""")

    q("csv_round_trip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
    q("text_files", """SELECT coalesce(lang, 'none') AS lang, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS characters,
  CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS line_ends
FROM documents GROUP BY ALL""")
    q("normalized_nulls", """SELECT * REPLACE (
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS c_acctbal) FROM customer""")
    q("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
    missing = " + ".join(f"(count(*) - count({c}))" for c in ORDER_COLUMNS)
    some = missing.replace(" + (count(*) - count(mostly_null))", "")
    q("compare_before_after", f"""WITH {UNIQUE}
SELECT 'raw' AS version, count(*) AS "rows", CAST(7 AS BIGINT) AS "columns", {missing} AS "nulls" FROM orders_dirty
UNION ALL SELECT 'cleaned', count(*), CAST(6 AS BIGINT), {some} FROM base""")

    balance = """CASE WHEN k < 2 THEN 'single_class' WHEN r >= 0.8 THEN 'balanced'
  WHEN r >= 0.4 THEN 'slightly_imbalanced' WHEN r >= 0.1 THEN 'imbalanced' ELSE 'severely_imbalanced' END"""

    def classes(view, c):
        return f"SELECT {c} AS class, count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c}"

    q("target_classification", f"""SELECT 'o_orderstatus' AS target, 'classification' AS task_type,
  k AS n_classes, {balance} AS class_balance
FROM (SELECT count(*) AS k, min(n) / max(n) AS r FROM ({classes("orders", "o_orderstatus")}))""")
    q("target_regression", od + f"""SELECT "column" AS target, 'regression' AS task_type, mean, median, std, skewness,
  skew_label FROM ({numeric("orders_dirty", "o_totalprice", "o_totalprice")})""")
    q("class_distribution", f"""SELECT class, n AS "count" FROM ({classes("orders", "o_orderstatus")})""")
    q("class_balance", f"""SELECT k AS n_classes, round(r, 6) AS ratio, {balance} AS class_balance
FROM (SELECT count(*) AS k, min(n) / max(n) AS r FROM ({classes("events", "event_type")}))""")
    q("class_weights", f"""WITH c AS ({classes("lineitem", "l_linestatus")})
SELECT class, n AS "count", round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight,
  CASE WHEN count(*) OVER () = 2 THEN round(first_value(n) OVER (ORDER BY class)
    / last_value(n) OVER (ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) END AS positive_ratio
FROM c""")
    q("class_weighted_rows", f"""WITH c AS ({classes("orders", "o_orderstatus")}), w AS (SELECT class,
  round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS class_weight FROM c)
SELECT o_orderkey, o_orderstatus, class_weight FROM orders JOIN w ON o_orderstatus = class""")
    q("target_log", od + """SELECT o_orderkey, o_totalprice, round(ln(1 + o_totalprice), 4) AS o_totalprice_log,
  round(o_totalprice, 4) AS o_totalprice_back FROM orders_dirty""")
    q("feature_correlations", correlations("lineitem", "l_extendedprice", [c for c in LINE_NUMBERS if c != "l_extendedprice"]))
    q("feature_correlations_two_classes", correlations(
        "(SELECT *, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1.0 ELSE 0.0 END AS goal FROM lineitem)",
        "goal", LINE_NUMBERS))
    q("feature_suggestions", suggestions("part", {
        "p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number"}))
    q("feature_suggestions_dirty", od + suggestions("orders_dirty", ORDER_COLUMNS))
    q("feat_log1p", od + """SELECT o_orderkey, o_totalprice, round(ln(1 + o_totalprice), 4) AS o_totalprice_log
FROM orders_dirty""")
    q("feat_bins", """SELECT part.*, CAST(least(greatest(ceil((p_retailprice - lo) / w) - 1, 0), 4) AS INTEGER) AS p_retailprice_bin
FROM part, (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 5 AS w FROM part)""")
    q("feat_standardize", od + """SELECT o_orderkey, o_totalprice, round((o_totalprice - m) / s, 4) AS o_totalprice_scaled
FROM orders_dirty, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders_dirty)""")
    flag = "CAST(coalesce(o_orderpriority = '{}', false) AS INTEGER) AS {}"
    flags = ", ".join(flag.format(v, n) for v, n in [
        ("2-HIGH", "o_orderpriority_2_high"), ("3-MEDIUM", "o_orderpriority_3_medium"),
        ("4-NOT SPECIFIED", "o_orderpriority_4_not_specified"), ("5-LOW", "o_orderpriority_5_low")])
    q("feat_onehot", od + f"SELECT o_orderkey, {flags} FROM orders_dirty")
    q("feat_label", "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_enc FROM part")
    q("feat_target_mean", """SELECT p_partkey, p_type, p_retailprice,
  round(avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS p_type_target_mean FROM part""")

    kinds_of_part = ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    type_flags = ", ".join(f"CAST(p_type = '{k}' AS INTEGER) AS p_type_{k.lower()}" for k in kinds_of_part)
    q("feat_suggested", f"""SELECT p_partkey, p_brand, p_size, p_retailprice,
  CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_enc, {type_flags},
  CAST(least(greatest(ceil((p_size - lo) / w) - 1, 0), 4) AS INTEGER) AS p_size_bin
FROM part, (SELECT min(p_size) AS lo, (max(p_size) - min(p_size)) / 5 AS w FROM part)""")

    q("histogram", f"""SELECT "column", bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, "count"
FROM ({union([bins("lineitem", c, 20) for c in LINE_NUMBERS])})""")
    q("kde", f"""WITH b AS ({bins("lineitem", "l_extendedprice", 200)}),
s AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(x), -0.2) AS h
  FROM (SELECT l_extendedprice AS x FROM lineitem)),
g AS (SELECT lo + i * ((hi - lo) / 99) AS x, n, h FROM s, range(0, 100) AS r(i))
SELECT 'l_extendedprice' AS "column", round(x, 4) AS x, round(1e6 * sum("count" *
  exp(-0.5 * pow((x - (b.lo + (bin + 0.5) * w)) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g, b GROUP BY x, n, h""")
    q("correlation_matrix", od + union([
        f"""SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM orders_dirty"""
        for a in ORDER_NUMBERS for b in ORDER_NUMBERS]))
    q("top_bars", od + top_n("orders_dirty", ["o_orderpriority", "custkey_str"], 10))
    shares = union([
        f"""SELECT bucket, '{c}' AS "column",
  round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM b GROUP BY bucket"""
        for c in ORDER_COLUMNS])
    matrix = """b AS (SELECT *, least(CAST(floor((o_orderkey - lo) / w) AS BIGINT), 49) AS bucket FROM {0},
  (SELECT min(o_orderkey) AS lo, (max(o_orderkey) - min(o_orderkey)) / 50 AS w FROM {0}))"""
    q("nullity_matrix", od[:-1] + ", " + matrix.format("orders_dirty") + shares)
    q("box_stats", od + union([_whisker("orders_dirty", c) for c in ORDER_NUMBERS]))
    dist = [f"SELECT 'dist_{c}' AS chart, count(*) AS \"rows\" FROM ({bins('base', c, 20)})" for c in ORDER_NUMBERS]
    boxes = [f"SELECT 'box_{c}', 1" for c in ORDER_NUMBERS]
    q("dashboard_sizes", f"WITH {UNIQUE}, {matrix.format('base')} " + union([
        *dist, *boxes, "SELECT 'correlation_heatmap', 9",
        "SELECT 'nullity_matrix', 7 * count(DISTINCT bucket) FROM b",
        "SELECT 'bar_o_orderpriority', least(count(DISTINCT o_orderpriority), 10) FROM base"]))

    whiskers = ["q1", "median", "q3", "lower_whisker", "upper_whisker", "outlier_count"]
    q("dashboard_contents", f"WITH {UNIQUE}, {matrix.format('base')} SELECT chart, item, round(CAST(amount AS DOUBLE), 4) + 0.0 AS amount FROM (" + union([
        *[f"SELECT 'dist_{c}' AS chart, CAST(bin AS VARCHAR) AS item, CAST(\"count\" AS DOUBLE) AS amount FROM ({bins('base', c, 20)})" for c in ORDER_NUMBERS],
        *[f"SELECT 'box_{c}', '{w}', {w} FROM ({_whisker('base', c)})" for c in ORDER_NUMBERS for w in whiskers],
        *[f"SELECT 'correlation_heatmap', '{a}|{b}', corr({a}, {b}) FROM base" for a in ORDER_NUMBERS for b in ORDER_NUMBERS],
        f"""SELECT 'nullity_matrix', "column" || '|' || CAST(bucket AS VARCHAR), null_share FROM ({shares})""",
        f"SELECT 'bar_o_orderpriority', value, \"count\" FROM ({top_n('base', ['o_orderpriority'], 10)})"]) + ")")

    q("text_chunks", """SELECT doc_id, CAST(start / 450 AS BIGINT) AS chunk_id, CAST(start AS BIGINT) AS start,
  substr(text, CAST(start AS INTEGER) + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS start FROM documents)""")
    q("vector_topk", """WITH dims AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT label, i, avg(v) AS v FROM dims GROUP BY label, i),
queries AS (SELECT label AS query_id, list(v ORDER BY i) AS q FROM means GROUP BY label),
ranked AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score,
  row_number() OVER (PARTITION BY query_id
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS rank FROM queries, embeddings)
SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= 3 AND score > 0.3""")

    q("vector_self_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ranked AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 10) DESC, b.vec_id) AS rank FROM v a, v b)
SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= 3 AND score > 0.3""")
    word_vectors = r"""chunk AS (
  SELECT doc_id, start // 450 AS chunk_id, start, substr(text, CAST(start AS INTEGER) + 1, 500) AS text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS start FROM documents)),
asked AS ({asked}),
entry AS (
  SELECT '' AS query_id, doc_id, chunk_id, start, text FROM chunk WHERE trim(text) <> ''
  UNION ALL SELECT query_id, NULL, NULL, NULL, text FROM asked),
word AS (
  SELECT query_id, doc_id, chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')) AS w FROM entry),
tf AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS f, count(*) AS n FROM word GROUP BY ALL),
idf AS (
  SELECT f, ln(((SELECT count(*) FROM entry WHERE query_id = '') + 1) / (count(*) + 1)) AS idf FROM tf WHERE query_id = '' GROUP BY f),
all_idf AS (
  SELECT f.range AS f, coalesce(idf, ln((SELECT count(*) FROM entry WHERE query_id = '') + 1)) AS idf FROM range(256) f LEFT JOIN idf ON idf.f = f.range),
raw AS (SELECT *, n * idf AS w FROM tf JOIN all_idf USING (f)),
weight AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id, f,
    CAST(CAST(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY query_id, doc_id, chunk_id)), 0) AS FLOAT) AS DOUBLE) AS v FROM raw)"""
    q("hashed_embeddings", "WITH " + word_vectors.format(asked="SELECT '' AS query_id, '' AS text WHERE false") + """
SELECT c.doc_id, c.chunk_id, c.start, coalesce(string_agg(f || ':' || CAST(round(v * 10000) AS BIGINT), ' ' ORDER BY f)
  FILTER (WHERE round(v * 10000) <> 0), '') AS weights
FROM (SELECT * FROM entry WHERE query_id = '') c
LEFT JOIN weight w ON w.doc_id = c.doc_id AND w.chunk_id = c.chunk_id GROUP BY 1, 2, 3""")
    columns = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
    asked = " UNION ALL ".join(
        f"SELECT '{c}' AS query_id, 'column {c} description valid range constraints meaning' AS text" for c in columns
    )
    q("context_by_query", "WITH " + word_vectors.format(asked=asked) + """,
norm AS (SELECT query_id, doc_id, chunk_id, sqrt(sum(v * v)) AS norm FROM weight GROUP BY 1, 2, 3),
scored AS (
  SELECT a.query_id, b.doc_id, b.chunk_id, sum(a.v * b.v) AS dot FROM weight a JOIN weight b ON a.f = b.f
  WHERE a.query_id <> '' AND b.query_id = '' GROUP BY 1, 2, 3),
ranked AS (
  SELECT s.query_id, s.doc_id, s.chunk_id, dot / (p.norm * n.norm) AS score,
    row_number() OVER (PARTITION BY s.query_id ORDER BY round(dot / (p.norm * n.norm), 10) DESC, s.doc_id, s.chunk_id) AS rank
  FROM scored s JOIN norm p ON p.query_id = s.query_id
  JOIN norm n ON n.query_id = '' AND n.doc_id = s.doc_id AND n.chunk_id = s.chunk_id)
SELECT r.query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS context
FROM ranked r JOIN chunk c ON c.doc_id = r.doc_id AND c.chunk_id = r.chunk_id WHERE rank <= 3 AND score > 0.3 GROUP BY 1""")

    q("q_group_mean", """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
    q("q_filter", "SELECT * FROM customer WHERE c_acctbal > 9000")
    q("q_filter_exact", "SELECT * FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand = 'Brand#11'")
    q("q_row_count", """SELECT count(*) AS "rows" FROM lineitem""")
    q("q_value_counts", """SELECT p_size AS value, count(*) AS "count" FROM part GROUP BY p_size""")
    q("q_percent", "SELECT round(100.0 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS percent FROM labels")
    q("q_corr", union([f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM part"
                       for a in ("p_size", "p_retailprice") for b in ("p_size", "p_retailprice")]))
    q("q_null_counts", od + union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count FROM orders_dirty""" for c in ORDER_COLUMNS]))
    q("q_chart_series", """SELECT o_orderpriority AS category, CAST(count(*) AS DOUBLE) AS value FROM orders
GROUP BY o_orderpriority""")
    q("q_chart_scatter", "SELECT p_size, p_retailprice FROM part")
    q("q_structured", """SELECT l_returnflag, l_linestatus, count(*) AS lines, round(avg(l_extendedprice), 4) AS mean_price,
  count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity >= 10
GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100""")
    q("q_sql", """SELECT o_orderstatus, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders
GROUP BY o_orderstatus""")

    q("c_project", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net_price FROM lineitem""")
    q("c_predicates", """SELECT * FROM part WHERE (p_size BETWEEN 5 AND 15 AND p_brand NOT IN ('Brand#11', 'Brand#12'))
  OR p_type LIKE '%PROMO%'""")
    q("c_group_agg", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers,
  min(o_totalprice) AS smallest, max(o_totalprice) AS largest, round(stddev_samp(o_totalprice), 4) AS spread
FROM orders GROUP BY o_orderpriority, o_orderstatus""")
    q("c_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
    q("c_rank", """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rank FROM lineitem""")
    q("c_rank_average", """SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size)
  + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part""".replace("rank() OVER", "CAST(rank() OVER").replace(
        "ORDER BY p_size)\n", "ORDER BY p_size) AS DOUBLE)\n"))
    q("c_row_number", f"""SELECT {LINE_ORDER}, l_returnflag,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_ORDER}) AS row_number FROM lineitem""")
    q("c_lag", """SELECT event_id, ts, user_id, value,
  lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_shift FROM events""")
    q("c_diff", """SELECT event_id, ts, value, round(value - p, 4) + 0.0 AS value_diff,
  round(value / nullif(p, 0) - 1, 4) + 0.0 AS value_pct_change
FROM (SELECT event_id, ts, value, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events)""")
    q("c_cumsum", f"""SELECT {LINE_ORDER}, l_returnflag, l_quantity, round(sum(l_quantity)
  OVER (PARTITION BY l_returnflag ORDER BY {LINE_ORDER} {UPTO}), 4) AS l_quantity_cumsum FROM lineitem""")
    q("c_expanding_mean", f"""SELECT {LINE_ORDER}, l_quantity, sum(l_quantity) OVER (ORDER BY {LINE_ORDER} {UPTO})
  / count(*) OVER (ORDER BY {LINE_ORDER} {UPTO}) AS l_quantity_expanding_mean FROM lineitem""")
    seven = f"OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    q("c_rolling", f"""SELECT {LINE_ORDER}, l_quantity, CASE WHEN count(l_quantity) {seven} = 7
  THEN round(avg(l_quantity) {seven}, 4) END AS l_quantity_rolling FROM lineitem""")
    q("c_cube", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
    q("c_rollup", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
    q("c_pivot", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
FROM orders GROUP BY o_orderpriority""")
    q("c_self_join", """SELECT o_orderkey, round(o_totalprice - m, 6) + 0.0 AS above_mean FROM orders
JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = k""")
    q("c_semi_join", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000)""")
    q("c_anti_join", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
    q("c_asof", """SELECT v.event_id, v.ts, v.user_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type <> 'click') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts""")
    q("c_union", """SELECT nation, count(*) AS n, round(sum(balance), 4) AS balance FROM (
  SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY nation""")
    q("c_intersect", "SELECT l_partkey AS key FROM lineitem INTERSECT SELECT p_partkey FROM part")
    q("c_except", """SELECT c_custkey AS key FROM customer EXCEPT ALL
  SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000""")
    q("c_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
    q("c_nsmallest", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 10""")
    q("c_month_resample", """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""")
    q("c_string", """SELECT p_partkey, upper(trim(p_name)) AS name, replace(p_brand, '#', ' ') AS brand,
  split_part(p_type, ' ', 1) AS first_word, length(p_type) AS size FROM part""")
    q("c_case", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END
  AS size_class, round(abs(ln(1 + p_retailprice)), 4) AS log_price FROM part""")
    q("c_melt", union([f"""SELECT '{c}' AS variable, count(*) AS n, round(sum({c}), 4) AS total FROM lineitem"""
                       for c in ("l_quantity", "l_discount", "l_tax")]))
    q("c_quantiles", union([
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"""
        for c in ("l_extendedprice", "l_quantity") for p in (0.01, 0.1, 0.5, 0.9, 0.99)]))
    q("c_words", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents)
WHERE word <> '' GROUP BY word""")
    q("c_json", """SELECT event_type, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS with_k,
  count(*) AS n FROM events GROUP BY event_type""")
    q("c_describe", union([f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
  round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max
FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount")]))

    # Other plans, the same rows.
    q("scale_lead", """SELECT event_id, ts, value, lead(value, 2) OVER (ORDER BY ts, event_id) AS value_shift FROM events""")
    q("c_resample", """WITH few AS (
  SELECT o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_totalprice FROM orders WHERE o_orderkey % 83 = 5),
spine AS (SELECT o_orderstatus, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS period FROM few GROUP BY 1)
SELECT s.o_orderstatus, s.period, count(o_totalprice) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_totalprice) AS largest
FROM spine s LEFT JOIN few f ON s.o_orderstatus = f.o_orderstatus AND s.period = f.period GROUP BY 1, 2""")
    by_line = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    q("c_group_quantiles", f"""WITH often AS (
  SELECT l_returnflag, l_linestatus, first(l_quantity ORDER BY n DESC, l_quantity) AS common_quantity
  FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 4) AS median_price,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS high_price, round(median(l_tax), 4) AS median_tax,
  any_value(common_quantity) AS common_quantity,
  first(l_partkey ORDER BY {by_line}) AS first_part, last(l_partkey ORDER BY {by_line}) AS last_part
FROM lineitem JOIN often USING (l_returnflag, l_linestatus) GROUP BY 1, 2""")
    q("scale_group_quantiles", """SELECT CASE WHEN o_orderkey % 10 > 0 THEN 'hot' ELSE o_orderpriority END AS g,
  round(quantile_cont(o_totalprice, 0.01), 4) AS q0, round(median(o_totalprice), 4) AS q1,
  round(quantile_cont(o_totalprice, 0.9), 4) AS q2 FROM orders GROUP BY 1""")
    q("scale_first_values", ev + "SELECT * FROM (" + union([
        f"""SELECT * FROM (SELECT '{c}' AS "column", event_type, event_id, CAST({c} AS DOUBLE) AS value
  FROM events_dirty WHERE {c} IS NOT NULL ORDER BY event_type, event_id LIMIT {n})"""
        for c, n in (("value", 40), ("user_id", 3))]) + ")")
    q("scale_drop_duplicates", sql["drop_duplicates"])
    for name in ("quantiles", "self_join", "row_number", "lag", "cumsum", "rolling", "asof"):
        q(f"scale_{name}", sql[f"c_{name}"])
    return sql
