"""Canonical views of the star-schema tables: events as trades and depth levels, orders as publications, parts as instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB's form of the same views; T, D, P and E below name them in the queries' SQL.
TRADES_SQL = "t AS (SELECT event_id AS trade_id, epoch_us(ts) * 1000 AS event_timestamp_ns, user_id AS instrument_id, event_type AS stream_id, value AS price, CAST(props->>'$.k' AS BIGINT) AS quantity FROM events)"
LEVELS_SQL = "d AS (SELECT event_id AS ordinal, epoch_us(ts) * 1000 AS event_timestamp_ns, user_id AS book, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CAST(floor(value / 10) AS BIGINT) AS price, CAST(props->>'$.k' AS BIGINT) % 10 AS quantity, (event_id // 150) % 8 = 0 AS is_init FROM events)"
TASKS_SQL = "p AS (SELECT o_orderkey AS task_id, o_custkey AS dataset_id, epoch_us(o_orderdate) // 86400000000 AS start, epoch_us(o_orderdate) // 86400000000 + 30 + o_orderkey % 90 AS \"end\", o_orderpriority AS source, o_orderstatus AS kind, o_totalprice AS amount FROM orders)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id trade_id", f"{_micros('ts')} * 1000 event_timestamp_ns", "user_id instrument_id", "event_type stream_id", "value price", "cast(get_json_object(props, '$.k') as bigint) quantity")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id ordinal", f"{_micros('ts')} * 1000 event_timestamp_ns", "user_id book", "if(event_id % 2 = 0, 'bid', 'ask') side", "cast(floor(value / 10) as bigint) price", "cast(get_json_object(props, '$.k') as bigint) % 10 quantity", "(event_id div 150) % 8 = 0 is_init")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = f"{_micros('o_orderdate')} div 86400000000"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey task_id", "o_custkey dataset_id", f"{day} start", f"{day} + 30 + o_orderkey % 90 `end`", "o_orderpriority source", "o_orderstatus kind", "o_totalprice amount")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping sources of the trades, two of them with some rows of their own content."""
    t = trades(spark, sf_dir)
    twice = t.where("trade_id % 5 = 0").withColumn("source", F.lit(1))
    other = t.where("trade_id % 7 = 0").withColumn("price", F.when(F.col("trade_id") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))).withColumn("source", F.lit(2))
    return t.withColumn("source", F.lit(0)).unionByName(twice).unionByName(other)


SOURCES_SQL = "s AS (SELECT *, 0 AS source FROM t UNION ALL SELECT *, 1 FROM t WHERE trade_id % 5 = 0 UNION ALL SELECT trade_id, event_timestamp_ns, instrument_id, stream_id, CASE WHEN trade_id % 3 = 0 THEN price + 1 ELSE price END, quantity, 2 FROM t WHERE trade_id % 7 = 0)"
