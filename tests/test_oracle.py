"""Registered queries against their SQL; ``python -m tests.compare`` runs all of them."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import SF

SAMPLE = """
table_profile profile_numeric column_profile infer_types top_values_by_column merged_profile
drop_duplicates to_datetime to_categorical fill_median fill_forward_by_user planned_outliers
cleaning_plan clean_orders feature_correlations feature_suggestions feat_onehot histogram kde box_stats
text_chunks vector_topk q_structured c_rank c_cumsum c_rolling c_asof c_describe
scale_quantiles scale_drop_duplicates scale_self_join scale_row_number scale_lag scale_lead scale_cumsum
scale_rolling scale_asof
""".split()


@pytest.fixture(scope="module")
def other_engine():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, other_engine, name):
    result = compare(spark, other_engine, name, SF)
    assert result.startswith("ok (") and "types" not in result


def test_every_query_is_compared_or_known():
    without = set(entry.queries()) - set(entry.oracle_sql()) - set(entry.training_queries())
    assert without == {"hashed_embeddings", "context_by_query"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 11
