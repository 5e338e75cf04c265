"""Every operator as a query over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import as_double
from .functions.counts import distinct_counts, most_frequent
from .functions.group_quantiles import group_quantiles
from .functions.leading import first_values, leading_values
from .functions.quantiles import exact_quantiles
from .operators import dashboard, features, merge, nulls, ordered, outliers, query, retrieval, rows, target, types
from .operators import profile as prof
from .operators.joins import attach
from .plans import rules
from .plans.execute import apply_plan
from .plans.run import clean, propose
from .session import materialize, new_folder
from .sources import tables
from .views import load

Query = Callable[[SparkSession, str], DataFrame]

ORDERS_ORDER = ["o_orderkey", "date_str"]
EVENTS_ORDER = ["ts", "event_id"]
ORDERS_NUMBERS = ["o_orderkey", "o_totalprice", "mostly_null"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_REGISTRY: dict[str, Query] = {}


def register(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders_dirty")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events_dirty")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Profile


@register
def table_profile(spark, sf):  # P1 P2
    return prof.table_profile(orders(spark, sf))


@register
def null_profile(spark, sf):  # P3
    return prof.null_profile(orders(spark, sf))


@register
def profile_numeric(spark, sf):  # P3 P6-P9
    return prof.numeric_profile(orders(spark, sf), ORDERS_NUMBERS)


@register
def profile_lineitem(spark, sf):  # P3 P6-P9 on a clean table, large columns
    return prof.numeric_profile(load(spark, sf, "lineitem"))


@register
def profile_unique(spark, sf):  # P4
    return distinct_counts(orders(spark, sf))


@register
def profile_samples(spark, sf):  # P5
    found = leading_values(orders(spark, sf), ORDERS_ORDER, ORDERS_NUMBERS + ["o_orderpriority", "custkey_str"])
    pairs = [(c, i + 1, v) for c, lead in found.items() for i, v in enumerate(lead.samples)]
    return spark.createDataFrame(pairs, "column string, position bigint, value string")


@register
def profile_dates(spark, sf):  # P10
    found = prof.profile(orders(spark, sf).select(*ORDERS_ORDER, "o_orderdate"), ORDERS_ORDER, duplicates=False)
    return (
        found.to_df(spark)
        .filter(F.col("min_date").isNotNull())
        .select("column", "type_category", "min_date", "max_date")
    )


@register
def infer_types(spark, sf):  # P11 P13 C1
    return types.detect_type_issues(orders(spark, sf), ORDERS_ORDER)


@register
def profile_converted(spark, sf):  # P12
    return prof.converted_profile(orders(spark, sf), ["custkey_str"])


@register
def top_values_by_column(spark, sf):  # P14
    found = most_frequent(orders(spark, sf), ["o_orderpriority", "custkey_str", "date_str"], 5)
    return found.withColumn("position", F.col("position").cast("bigint"))


@register
def column_profile(spark, sf):  # P15
    found = prof.column_profile(orders(spark, sf), ORDERS_ORDER)
    return found.drop("sample_values", "top_values", "dtype")


@register
def summary_flags(spark, sf):  # P17
    flags = prof.summary_flags(prof.column_profile(orders(spark, sf), ORDERS_ORDER))
    return flags.select(*[F.array_join(c, ",").alias(c) for c in flags.columns])


@register
def merged_profile(spark, sf):  # P16
    months = F.date_trunc("month", "l_shipdate")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    states = materialize(merge.profile_states(load(spark, sf, "lineitem"), columns, months))
    return merge.merge_states(states).select(
        "column", "rows", "null_count", "null_percent", "mean", "std", "min", "max", "skewness", "skew_label"
    )


@register
def merged_top_values(spark, sf):  # P16
    lines = load(spark, sf, "lineitem")
    halves = F.coalesce(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"), F.lit(False))
    columns = ["l_returnflag", "l_linestatus"]
    states = merge.frequency_states(lines, columns, halves).unionByName(
        merge.frequency_states(lines, columns, ~halves)
    )
    return merge.merge_frequencies(states).withColumn("position", F.col("position").cast("bigint"))


# Names, rows and types


@register
def drop_duplicates(spark, sf):  # C7
    return rows.drop_duplicates(orders(spark, sf))


@register
def standardize_names(spark, sf):  # C6
    raw = load(spark, sf, "customer").toDF(
        " Cust Key", "Cust-Name", "Nation Key!", "Acct Bal ($)", "mktsegment"
    )
    return rows.standardize_names(raw)


@register
def to_numeric(spark, sf):  # C2
    return types.to_numeric(orders(spark, sf).select("o_orderkey", "custkey_str"), "custkey_str")


@register
def to_datetime(spark, sf):  # C3
    return types.to_datetime(orders(spark, sf).select("o_orderkey", "date_str"), "date_str")


@register
def to_categorical(spark, sf):  # C4
    return types.to_categorical(orders(spark, sf).select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@register
def type_fixes(spark, sf):  # C5
    fixes = {
        "custkey_str": "should_be_numeric",
        "date_str": "should_be_datetime",
        "o_orderpriority": "should_be_categorical",
        "o_orderkey": "no_such_issue",
    }
    return types.apply_type_fixes(orders(spark, sf), fixes)


# Nulls


@register
def null_strategy(spark, sf):  # N1
    found = prof.column_profile(orders(spark, sf), ORDERS_ORDER)
    return nulls.null_strategy(found).select("column", "strategy")


@register
def fill_mean(spark, sf):  # N2
    return rounded(nulls.fill_mean(orders(spark, sf), "o_totalprice"), "o_totalprice")


@register
def fill_median(spark, sf):  # N3
    return rounded(nulls.fill_median(orders(spark, sf), "o_totalprice"), "o_totalprice")


@register
def fill_mode(spark, sf):  # N4
    return nulls.fill_mode(orders(spark, sf), "o_orderpriority")


@register
def fill_forward(spark, sf):  # N5
    return nulls.fill_forward(events(spark, sf), "value", EVENTS_ORDER)


@register
def fill_forward_by_user(spark, sf):  # N5
    return nulls.fill_forward(events(spark, sf), "value", EVENTS_ORDER, ["user_id"])


@register
def drop_column(spark, sf):  # N6
    return nulls.drop_column(orders(spark, sf), "mostly_null")


@register
def drop_null_rows(spark, sf):  # N7
    return nulls.drop_null_rows(orders(spark, sf), "o_totalprice")


@register
def auto_nulls(spark, sf):  # N8
    typed = rows.drop_duplicates(orders(spark, sf))
    cleaned, _ = nulls.auto_nulls(typed, prof.profile(typed, ORDERS_ORDER), ORDERS_ORDER)
    return rounded(cleaned, "o_totalprice")


@register
def planned_nulls(spark, sf):  # N9
    table = rows.drop_duplicates(orders(spark, sf))
    plan = {
        "o_totalprice": "drop_rows",
        "o_orderpriority": "fill_mode",
        "mostly_null": "fill_mean",
        "o_orderkey": "fill_mean",
    }
    cleaned, _ = nulls.auto_nulls(table, None, ORDERS_ORDER, plan)
    return rounded(cleaned, "mostly_null")


# Outliers


@register
def outliers_iqr(spark, sf):  # O1
    flagged = outliers.flag_iqr(orders(spark, sf), "o_totalprice")
    return flagged.select("o_orderkey", "o_totalprice", "is_outlier")


@register
def outliers_zscore(spark, sf):  # O2
    flagged = outliers.flag_zscore(orders(spark, sf), "o_totalprice")
    return flagged.select("o_orderkey", "o_totalprice", "is_outlier")


@register
def cap_outliers(spark, sf):  # O3
    return rounded(outliers.cap_outliers(orders(spark, sf), "o_totalprice"), "o_totalprice")


@register
def drop_outliers(spark, sf):  # O4
    return outliers.drop_outliers(orders(spark, sf), "o_totalprice")


@register
def auto_outliers(spark, sf):  # O5
    table = orders(spark, sf)
    cleaned, _ = outliers.auto_outliers(table, prof.profile(table, ORDERS_ORDER, duplicates=False), "cap")
    return rounded(cleaned, "o_totalprice")


@register
def planned_outliers(spark, sf):  # O6
    cleaned, _ = outliers.auto_outliers(
        events(spark, sf), None, strategies={"value": "drop", "event_type": "cap", "user_id": "cap"}
    )
    return rounded(cleaned, "user_id")


@register
def outlier_strategy(spark, sf):  # O7
    found = prof.profile(orders(spark, sf), ORDERS_ORDER, duplicates=False)
    chosen = outliers.outlier_strategy(found.to_df(spark), found.rows)
    return chosen.select("column", "outlier_count", "strategy")


# Plans


def _plan(spark, sf):
    return propose(orders(spark, sf), ORDERS_ORDER)[1]


@register
def cleaning_plan(spark, sf):  # L1
    return _plan(spark, sf).select(F.col("seq").cast("bigint").alias("seq"), "stage", "column", "action")


@register
def plan_warnings(spark, sf):  # L2
    lines = load(spark, sf, "orders")
    return rules.validate_plan(_plan(spark, sf), lines)


@register
def plan_overrides(spark, sf):  # L3
    chosen = spark.createDataFrame(
        [("o_totalprice", "fill_mean"), ("o_orderkey", "drop_rows")], "column string, action string"
    )
    replaced = rules.override_plan(_plan(spark, sf), chosen)
    return replaced.filter(F.col("stage") == "nulls").select("column", "action")


@register
def plan_remapped(spark, sf):  # L4
    table = orders(spark, sf).withColumnRenamed("o_totalprice", "Total Price ($)")
    _, plan = propose(table, ORDERS_ORDER)
    renamed = rules.remap_plan(plan, rules.name_map(spark, table.columns))
    return renamed.filter(F.col("column").isNotNull()).select("stage", "column", "action")


@register
def clean_orders(spark, sf):  # L5 L6
    found = clean(orders(spark, sf), ORDERS_ORDER, analyse=False)
    return rounded(found.cleaned, "o_totalprice")


@register
def cleaning_log(spark, sf):  # L5
    table = orders(spark, sf)
    _, log = apply_plan(table, _plan(spark, sf), ORDERS_ORDER)
    return log.filter(F.col("rows_affected").isNotNull()).select("stage", "column", "action", "rows_affected")


# Sources and whole tables


@register
def csv_round_trip(spark, sf):  # S1 S2
    path = new_folder(spark, "csv")
    source = load(spark, sf, "customer")
    tables.write_csv(source, path)
    return tables.read_csv(spark, path)


@register
def text_files(spark, sf):  # S3
    """Documents written as text files by language, read back whole: characters and line ends by language."""
    path = new_folder(spark, "text")
    documents = load(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    documents.write.partitionBy("lang").text(path)
    files = tables.read_text(spark, f"{path}/*/*")
    lang = F.regexp_extract("doc_id", "lang=([^/]+)", 1)
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy(lang.alias("lang")).agg(
        F.sum(F.length("text")).alias("characters"), F.sum(ends).cast("bigint").alias("line_ends")
    )


@register
def normalized_nulls(spark, sf):  # S4
    tokens = F.when(F.col("c_mktsegment") == "BUILDING", "N/A").when(F.col("c_mktsegment") == "MACHINERY", "")
    raw = load(spark, sf, "customer").withColumns(
        {
            "c_mktsegment": F.coalesce(tokens, "c_mktsegment"),
            "c_acctbal": F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal")),
        }
    )
    return tables.normalize_nulls(raw)


@register
def preview_orders(spark, sf):  # S5
    return tables.preview(load(spark, sf, "orders"), ["o_orderkey"])


@register
def compare_before_after(spark, sf):  # S6
    table = orders(spark, sf)
    return tables.compare(table, rows.drop_duplicates(table).drop("mostly_null"))


# Target and features


@register
def target_classification(spark, sf):  # T1
    return target.target_summary(load(spark, sf, "orders"), "o_orderstatus")


@register
def target_regression(spark, sf):  # T1 T4
    return target.target_summary(orders(spark, sf), "o_totalprice")


@register
def class_distribution(spark, sf):  # T2
    return target.class_distribution(load(spark, sf, "orders"), "o_orderstatus")


@register
def class_balance(spark, sf):  # T3
    return rounded(target.class_balance(load(spark, sf, "events"), "event_type"), "ratio", digits=6)


@register
def class_weights(spark, sf):  # T7
    return rounded(
        target.class_weights(load(spark, sf, "lineitem"), "l_linestatus"), "weight", "positive_ratio", digits=6
    )


@register
def class_weighted_rows(spark, sf):  # T7
    weighted = target.weighted_rows(load(spark, sf, "orders"), "o_orderstatus")
    return rounded(weighted.select("o_orderkey", "o_orderstatus", "class_weight"), "class_weight", digits=6)


@register
def target_log(spark, sf):  # T8
    logged = target.log_target(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice")
    back = target.unlog_target(logged, "o_totalprice_log", "o_totalprice_back")
    return rounded(back, "o_totalprice_log", "o_totalprice_back")


@register
def feature_correlations(spark, sf):  # T5 T6
    return target.feature_correlations(load(spark, sf, "lineitem"), "l_extendedprice")


@register
def feature_correlations_two_classes(spark, sf):  # T5 T6
    return target.feature_correlations(load(spark, sf, "lineitem"), "l_linestatus")


@register
def feature_suggestions(spark, sf):  # E1
    return features.suggest_features(load(spark, sf, "part"), "p_retailprice").select("column", "suggestion")


@register
def feature_suggestions_dirty(spark, sf):  # E1
    return features.suggest_features(orders(spark, sf)).select("column", "suggestion")


@register
def feat_log1p(spark, sf):  # E2
    return rounded(
        features.add_log1p(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice"),
        "o_totalprice_log",
    )


@register
def feat_bins(spark, sf):  # E3
    return features.add_bins(load(spark, sf, "part"), "p_retailprice")


@register
def feat_standardize(spark, sf):  # E4
    scaled = features.add_standardized(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rounded(scaled, "o_totalprice_scaled")


@register
def feat_onehot(spark, sf):  # E5
    flags = features.add_onehot(orders(spark, sf).select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return flags.toDF(*rows.standard_names(flags.columns))


@register
def feat_label(spark, sf):  # E6
    return features.add_label(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@register
def feat_target_mean(spark, sf):  # E6
    part = load(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return rounded(features.add_target_mean(part, "p_type", "p_retailprice"), "p_type_target_mean")


@register
def feat_suggested(spark, sf):  # E1-E7
    part = load(spark, sf, "part")
    made = features.apply_suggestions(part, features.suggest_features(part, "p_retailprice"), ["p_partkey"])
    return made.toDF(*rows.standard_names(made.columns))


# Dashboard


@register
def histogram(spark, sf):  # V1
    return rounded(dashboard.histogram(load(spark, sf, "lineitem"), nbins=20), "low", "high").withColumn(
        "bin", F.col("bin").cast("bigint")
    )


@register
def kde(spark, sf):  # V2
    found = dashboard.density(load(spark, sf, "lineitem"), "l_extendedprice")
    return found.select("column", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@register
def correlation_matrix(spark, sf):  # V3
    return rounded(dashboard.correlation_matrix(orders(spark, sf)), "r", digits=6)


@register
def top_bars(spark, sf):  # V4
    found = dashboard.top_bars(orders(spark, sf), ["o_orderpriority", "custkey_str"])
    return found.withColumn("position", F.col("position").cast("bigint"))


@register
def nullity_matrix(spark, sf):  # V5
    shares = dashboard.nullity_matrix(orders(spark, sf), "o_orderkey")
    return rounded(shares, "null_share", digits=6).withColumn("bucket", F.col("bucket").cast("bigint"))


@register
def box_stats(spark, sf):  # V6
    found = dashboard.box_stats(orders(spark, sf), ORDERS_NUMBERS)
    return rounded(found, "q1", "median", "q3", "lower_whisker", "upper_whisker")


@register
def dashboard_sizes(spark, sf):  # V7
    table = rows.drop_duplicates(orders(spark, sf))
    found = prof.profile(table, ORDERS_ORDER, duplicates=False)
    charts = dashboard.dashboard(table, found, "o_orderkey")
    sizes = [(name, chart.count()) for name, chart in charts.items()]
    return spark.createDataFrame(sizes, "chart string, rows bigint")


@register
def dashboard_contents(spark, sf):  # V7
    """Every chart of the dashboard as ``(chart, item, amount)``."""
    table = rows.drop_duplicates(orders(spark, sf))
    found = prof.profile(table, ORDERS_ORDER, duplicates=False)
    parts = []
    for name, chart in dashboard.dashboard(table, found, "o_orderkey").items():
        if name.startswith("dist_"):
            cells = [(F.col("bin").cast("string"), F.col("count"))]
        elif name.startswith("box_"):
            cells = [(F.lit(c), F.col(c)) for c in chart.columns if c != "column"]
        elif name.startswith("bar_"):
            cells = [(F.col("value"), F.col("count"))]
        elif name == "correlation_heatmap":
            cells = [(F.concat_ws("|", "x", "y"), F.col("r"))]
        else:
            cells = [(F.concat_ws("|", "column", F.col("bucket").cast("string")), F.col("null_share"))]
        pairs = F.array(*[F.struct(i.alias("item"), a.cast("double").alias("amount")) for i, a in cells])
        parts.append(chart.select(F.lit(name).alias("chart"), F.inline(pairs)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return rounded(whole, "amount")


# Retrieval


@register
def text_chunks(spark, sf):  # R1
    found = retrieval.chunks(load(spark, sf, "documents"))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_id", "start")})


def _label_queries(vectors: DataFrame) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    dims = vectors.select(F.col("label"), F.posexplode("vector").alias("i", "v"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy(F.col("label").alias("query_id")).agg(entries["v"].alias("vector"))


@register
def vector_topk(spark, sf):  # R3
    vectors = load(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    found = retrieval.top_matches(vectors, _label_queries(vectors), ["vec_id"])
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("bigint"))


@register
def vector_self_topk(spark, sf):  # R3, every vector is a query
    vectors = load(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "vector")
    found = retrieval.top_matches(vectors, asked, ["vec_id"], block=256, cell=512)
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("bigint"))


@register
def hashed_embeddings(spark, sf):  # R2; weights in ten thousandths, as feature:weight
    found = retrieval.embed_chunks(retrieval.chunks(load(spark, sf, "documents")))
    weights = F.transform("vector", lambda v, i: F.struct(i.alias("f"), F.round(v.cast("double") * 10_000).cast("bigint").alias("w")))
    pairs = F.transform(F.filter(weights, lambda x: x["w"] != 0), lambda x: F.concat_ws(":", x["f"], x["w"]))
    return found.select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("start").cast("bigint").alias("start"),
        F.array_join(pairs, " ").alias("weights"),
    )


@register
def context_by_query(spark, sf):  # R4
    docs = retrieval.chunks(load(spark, sf, "documents"))
    return retrieval.context_for_columns(spark, load(spark, sf, "orders").columns, docs)


# Questions


@register
def q_group_mean(spark, sf):  # Q1
    return rounded(query.group_mean(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "mean_o_totalprice")


@register
def q_filter(spark, sf):  # Q2
    return query.filter_rows(load(spark, sf, "customer"), "c_acctbal", ">", 9000.0)


@register
def q_filter_exact(spark, sf):  # Q2
    tests = [("p_size", ">=", 10), ("p_size", "<", 20), ("p_brand", "==", "Brand#11")]
    return query.run_query(load(spark, sf, "part"), {"where": tests})


@register
def q_row_count(spark, sf):  # Q3
    return query.row_count(load(spark, sf, "lineitem"))


@register
def q_value_counts(spark, sf):  # Q4
    return query.value_counts(load(spark, sf, "part"), "p_size")


@register
def q_percent(spark, sf):  # Q5
    return rounded(query.percentage(load(spark, sf, "labels"), F.col("quality") == 1), "percent")


@register
def q_corr(spark, sf):  # Q6
    return rounded(query.pair_correlation(load(spark, sf, "part"), "p_size", "p_retailprice"), "r", digits=6)


@register
def q_null_counts(spark, sf):  # Q7
    return query.null_counts(orders(spark, sf))


@register
def q_chart_series(spark, sf):  # Q8
    counts = query.value_counts(load(spark, sf, "orders"), "o_orderpriority")
    return query.chart_series(counts, "bar")


@register
def q_chart_scatter(spark, sf):  # Q8
    return query.chart_series(load(spark, sf, "part").select("p_size", "p_retailprice", "p_brand"), "scatter")


@register
def q_structured(spark, sf):  # Q9 Q10
    spec = {
        "where": [("l_quantity", ">=", 10.0)],
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggs": {"lines": ("count", "*"), "mean_price": ("mean", "l_extendedprice"), "parts": ("nunique", "l_partkey")},
        "having": [("lines", ">", 100)],
        "order_by": ["-lines"],
    }
    return rounded(query.run_query(load(spark, sf, "lineitem"), spec), "mean_price")


@register
def q_sql(spark, sf):  # Q9 Q10
    text = "SELECT o_orderstatus, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM {df} GROUP BY 1"
    return query.run_sql(load(spark, sf, "orders"), text)


# Questions as specifications


def col(name: str) -> tuple:
    return ("col", name)


def keyed(name: str) -> dict:
    """A specification of one column, as key."""
    return {"compute": {"key": col(name)}, "select": ["key"]}


@register
def c_project(spark, sf):
    net = ("mul", col("l_extendedprice"), ("sub", 1, col("l_discount")))
    spec = {"compute": {"net_price": ("round", net, 4)}, "select": ["l_orderkey", "l_linenumber", "net_price"]}
    return query.run_query(load(spark, sf, "lineitem"), spec)


@register
def c_predicates(spark, sf):
    both = [("p_size", "between", (5, 15)), ("not", [("p_brand", "in", ["Brand#11", "Brand#12"])])]
    return query.run_query(load(spark, sf, "part"), {"where": [("any", [("all", both), ("p_type", "contains", "PROMO")])]})


@register
def c_group_agg(spark, sf):
    spec = {
        "group_by": ["o_orderpriority", "o_orderstatus"],
        "aggs": {
            "n": ("count", "*"),
            "customers": ("nunique", "o_custkey"),
            "smallest": ("min", "o_totalprice"),
            "largest": ("max", "o_totalprice"),
            "spread": ("std", "o_totalprice"),
        },
    }
    return rounded(query.run_query(load(spark, sf, "orders"), spec), "spread")


@register
def c_distinct(spark, sf):
    spec = {"select": ["l_returnflag", "l_linestatus", "l_linenumber"], "distinct": True}
    return query.run_query(load(spark, sf, "lineitem"), spec)


@register
def c_rank(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return ordered.rank_values(lines, "l_quantity", ["l_suppkey"]).withColumn("rank", F.col("rank").cast("bigint"))


@register
def c_rank_average(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_size")
    return ordered.rank_values(part, "p_size", method="average")


@register
def c_row_number(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag")
    return ordered.row_numbers(lines, LINE_ORDER, ["l_returnflag"])


@register
def c_lag(spark, sf):
    return ordered.shift(load(spark, sf, "events").select("event_id", "ts", "user_id", "value"), "value", EVENTS_ORDER, 1, ["user_id"])


@register
def c_diff(spark, sf):
    changed = ordered.changes(load(spark, sf, "events").select("event_id", "ts", "value"), "value", EVENTS_ORDER)
    return rounded(changed, "value_diff", "value_pct_change")


@register
def c_cumsum(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_quantity")
    return rounded(ordered.running_sum(lines, "l_quantity", LINE_ORDER, ["l_returnflag"]), "l_quantity_cumsum")


@register
def c_expanding_mean(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_quantity")
    return ordered.running_mean(lines, "l_quantity", LINE_ORDER)


@register
def c_rolling(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_quantity")
    return rounded(ordered.rolling_mean(lines, "l_quantity", LINE_ORDER, 7, ["l_suppkey"]), "l_quantity_rolling")


@register
def c_cube(spark, sf):
    spec = {
        "group_by": ["o_orderstatus", "o_orderpriority"],
        "grouping": "cube",
        "aggs": {"n": ("count", "*"), "mean_price": ("mean", "o_totalprice")},
        "compute_after": {"mean_price": ("round", col("mean_price"), 4)},
    }
    return query.run_query(load(spark, sf, "orders"), spec)


@register
def c_rollup(spark, sf):
    spec = {
        "compute": {"whole": ("cast", col("l_quantity"), "bigint")},
        "group_by": ["l_returnflag", "l_linestatus"],
        "grouping": "rollup",
        "aggs": {"n": ("count", "*"), "quantity": ("sum", "whole")},
    }
    return query.run_query(load(spark, sf, "lineitem"), spec)


@register
def c_pivot(spark, sf):
    spec = {
        "group_by": ["o_orderpriority"],
        "pivot": ("o_orderstatus", ["F", "O", "P"]),
        "aggs": {"n": ("count", "*")},
        "compute_after": {c.lower(): ("coalesce", col(c), 0) for c in "FOP"},
    }
    return query.run_query(load(spark, sf, "orders"), spec)


@register
def c_self_join(spark, sf):
    table = load(spark, sf, "orders")
    per_customer = table.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("count"))
    joined = attach(table, "o_custkey", per_customer, "mean_price", per_customer)
    return joined.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("mean_price"), 6).alias("above_mean"))


@register
def c_semi_join(spark, sf):
    large = {"group_by": ["o_custkey"], "aggs": {"m": ("max", "o_totalprice")}, "having": [("m", ">", 400000)]}
    spec = {"semi": (large, {"o_custkey": "o_custkey"}), "select": ["o_orderkey", "o_custkey"]}
    return query.run_query(load(spark, sf, "orders"), spec)


@register
def c_anti_join(spark, sf):
    large = {"from": "orders", "where": [("o_totalprice", ">", 450000)]}
    spec = {"anti": (large, {"c_custkey": "o_custkey"}), "select": ["c_custkey", "c_name"]}
    return query.run_query(load(spark, sf, "customer"), spec, {"orders": load(spark, sf, "orders")})


@register
def c_asof(spark, sf):
    table = load(spark, sf, "events")
    views = table.filter(F.col("event_type") != "click").select("event_id", "ts", "user_id")
    clicks = table.filter(F.col("event_type") == "click").select("ts", "user_id", F.col("value").alias("click_value"))
    return ordered.asof_join(views, clicks, "ts", ["user_id"], ["click_value"], "event_id")


@register
def c_union(spark, sf):
    def balances(start, letter):
        columns = {"nation": col(f"{letter}_nationkey"), "balance": col(f"{letter}_acctbal")}
        return start | {"compute": columns, "select": list(columns)}

    spec = {
        "from": balances({}, "c"),
        "union": balances({"from": "supplier"}, "s"),
        "group_by": ["nation"],
        "aggs": {"n": ("count", "*"), "balance": ("sum", "balance")},
        "compute_after": {"balance": ("round", col("balance"), 4)},
    }
    return query.run_query(load(spark, sf, "customer"), spec, {"supplier": load(spark, sf, "supplier")})


@register
def c_intersect(spark, sf):
    spec = {"from": keyed("l_partkey"), "intersect": {"from": "part"} | keyed("p_partkey")}
    return query.run_query(load(spark, sf, "lineitem"), spec, {"part": load(spark, sf, "part")})


@register
def c_except(spark, sf):
    large = {"from": "orders", "where": [("o_totalprice", ">", 450000)]}
    spec = {"from": keyed("c_custkey"), "except": large | keyed("o_custkey")}
    return query.run_query(load(spark, sf, "customer"), spec, {"orders": load(spark, sf, "orders")})


@register
def c_nlargest(spark, sf):
    spec = {"order_by": ["-o_totalprice", "o_orderkey"], "limit": 10, "select": ["o_orderkey", "o_totalprice"]}
    return query.run_query(load(spark, sf, "orders"), spec)


@register
def c_nsmallest(spark, sf):
    spec = {"order_by": ["l_extendedprice", "l_orderkey", "l_linenumber"], "limit": 10}
    return query.run_query(load(spark, sf, "lineitem"), spec).select("l_orderkey", "l_linenumber", "l_extendedprice")


@register
def c_month_resample(spark, sf):
    spec = {
        "compute": {"year": ("year", col("o_orderdate")), "month": ("month", col("o_orderdate"))},
        "group_by": ["year", "month"],
        "aggs": {"n": ("count", "*"), "total": ("sum", "o_totalprice")},
        "compute_after": {"total": ("round", col("total"), 2)},
    }
    return query.run_query(load(spark, sf, "orders"), spec)


@register
def c_resample(spark, sf):  # months without orders are rows too
    part = {"compute": {"r": ("mod", col("o_orderkey"), 83)}}
    few = query.run_query(load(spark, sf, "orders"), {"from": part, "where": [("r", "==", 5)]})
    aggs = {"n": ("count", "*"), "total": ("sum", "o_totalprice"), "largest": ("max", "o_totalprice")}
    return rounded(query.resample(few, "o_orderdate", "month", aggs, ["o_orderstatus"]), "total", digits=2)


@register
def c_group_quantiles(spark, sf):
    spec = {
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggs": {
            "n": ("count", "*"),
            "median_price": ("median", "l_extendedprice"),
            "high_price": ("quantile", "l_extendedprice", 0.99),
            "median_tax": ("median", "l_tax"),
            "common_quantity": ("mode", "l_quantity"),
            "first_part": ("first", "l_partkey", LINE_ORDER),
            "last_part": ("last", "l_partkey", LINE_ORDER),
        },
    }
    return rounded(query.run_query(load(spark, sf, "lineitem"), spec), "median_price", "high_price", "median_tax")


@register
def c_string(spark, sf):
    columns = {
        "name": ("upper", ("trim", col("p_name"))),
        "brand": ("replace", col("p_brand"), "#", " "),
        "first_word": ("part", col("p_type"), " ", 0),
        "size": ("length", col("p_type")),
    }
    return query.run_query(load(spark, sf, "part"), {"compute": columns, "select": ["p_partkey", *columns]})


@register
def c_case(spark, sf):
    size = col("p_size")
    columns = {
        "size_class": ("case", (("lt", size, 10), "small"), (("lt", size, 30), "medium"), "large"),
        "log_price": ("round", ("abs", ("log1p", col("p_retailprice"))), 4),
    }
    return query.run_query(load(spark, sf, "part"), {"compute": columns, "select": ["p_partkey", *columns]})


@register
def c_melt(spark, sf):
    spec = {
        "melt": {"keep": ["l_orderkey", "l_linenumber"], "values": ["l_quantity", "l_discount", "l_tax"]},
        "group_by": ["variable"],
        "aggs": {"n": ("count", "*"), "total": ("sum", "value")},
        "compute_after": {"total": ("round", col("total"), 4)},
    }
    return query.run_query(load(spark, sf, "lineitem"), spec)


def _line_quantiles(spark, sf, **options):
    table = load(spark, sf, "lineitem")
    probs = [0.01, 0.1, 0.5, 0.9, 0.99]
    columns = ["l_extendedprice", "l_quantity"]
    found = exact_quantiles(table, {c: as_double(c) for c in columns}, probs, **options)
    pairs = [(c, p, round(v, 4)) for c in columns for p, v in zip(probs, found[c])]
    return spark.createDataFrame(pairs, "column string, prob double, value double")


@register
def c_quantiles(spark, sf):
    return _line_quantiles(spark, sf)


@register
def c_describe(spark, sf):
    found = query.describe(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(found, "mean", "std", "min", "q1", "median", "q3", "max")


@register
def c_words(spark, sf):
    spec = {
        "explode": ("word", ("words", ("lower", col("text")), " ")),
        "group_by": ["word"],
        "aggs": {"n": ("count", "*")},
    }
    return query.run_query(load(spark, sf, "documents"), spec)


@register
def c_json(spark, sf):
    spec = {
        "compute": {"k": ("cast", ("json", col("props"), "$.k"), "double")},
        "group_by": ["event_type"],
        "aggs": {"with_k": ("count", "k"), "n": ("count", "*")},
    }
    return query.run_query(load(spark, sf, "events"), spec)


# The same operators in the plans of large tables: small ranges, small limits, equal results

RANGE = 2000


@register
def scale_quantiles(spark, sf):
    return _line_quantiles(spark, sf, direct_rows=1000)


@register
def scale_first_values(spark, sf):
    events = load(spark, sf, "events_dirty").repartition(5)
    found = first_values(events, ["event_type", "event_id"], {"value": 40, "user_id": 3})
    return found.select("column", F.col("order.k0").alias("event_type"), F.col("order.k1").alias("event_id"), F.col("text").cast("double").alias("value"))


@register
def scale_group_quantiles(spark, sf):  # one group holds nine tenths of the rows
    table = load(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderkey") % 10 > 0, "hot").otherwise(F.col("o_orderpriority")))
    found = group_quantiles(table, ["g"], F.col("o_totalprice"), [0.01, 0.5, 0.9], 100)
    return rounded(found, "q0", "q1", "q2")


@register
def scale_drop_duplicates(spark, sf):
    return rows.drop_duplicates(orders(spark, sf), 0)


@register
def scale_self_join(spark, sf):
    table = load(spark, sf, "orders")
    per_customer = table.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("count"))
    joined = attach(table, "o_custkey", per_customer, "mean_price", per_customer, limit=10)
    return joined.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("mean_price"), 6).alias("above_mean"))


@register
def scale_row_number(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag")
    return ordered.row_numbers(lines, LINE_ORDER, ["l_returnflag"], rows_per_range=RANGE)


@register
def scale_lag(spark, sf):
    table = load(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return ordered.shift(table, "value", EVENTS_ORDER, 1, ["user_id"], rows_per_range=RANGE)


@register
def scale_lead(spark, sf):
    table = load(spark, sf, "events").select("event_id", "ts", "value")
    return ordered.shift(table, "value", EVENTS_ORDER, -2, rows_per_range=RANGE)


@register
def scale_cumsum(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_quantity")
    summed = ordered.running_sum(lines, "l_quantity", LINE_ORDER, ["l_returnflag"], rows_per_range=RANGE)
    return rounded(summed, "l_quantity_cumsum")


@register
def scale_rolling(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_quantity")
    means = ordered.rolling_mean(lines, "l_quantity", LINE_ORDER, 7, ["l_suppkey"], rows_per_range=RANGE)
    return rounded(means, "l_quantity_rolling")


@register
def scale_asof(spark, sf):
    table = load(spark, sf, "events")
    views = table.filter(F.col("event_type") != "click").select("event_id", "ts", "user_id")
    clicks = table.filter(F.col("event_type") == "click").select("ts", "user_id", F.col("value").alias("click_value"))
    return ordered.asof_join(views, clicks, "ts", ["user_id"], ["click_value"], "event_id", rows_per_range=RANGE)
