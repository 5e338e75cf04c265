"""Views with known defects over the clean test tables, one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_DIRTY = """
WITH d AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20
              ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 50 = 7 THEN 'unknown'
              ELSE CAST(o_custkey AS VARCHAR(20)) END AS custkey_str,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS date_str,
         CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS mostly_null
  FROM orders)
SELECT * FROM d UNION ALL SELECT * FROM d WHERE o_orderkey % 101 = 0
"""

EVENTS_DIRTY = """
WITH d AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 3 <> 0 THEN NULL
              WHEN event_id % 60 = 0 THEN value * 50
              ELSE value END AS value
  FROM events)
SELECT * FROM d
"""

_VIEWS = {"orders_dirty": (ORDERS_DIRTY, "orders"), "events_dirty": (EVENTS_DIRTY, "events")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a dirty view over one."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, source = _VIEWS[name]
    return spark.sql(text.replace(f"FROM {source})", "FROM {source})"), source=load(spark, sf_dir, source))
