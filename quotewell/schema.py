"""Canonical schemas. Times are integer nanoseconds, prices and quantities DECIMAL(38,18), ordinals LONG."""

from __future__ import annotations

from pyspark.sql import types as T

DEC = T.DecimalType(38, 18)
IDENTITY = [
    T.StructField("event_timestamp_ns", T.LongType(), False),
    T.StructField("system_timestamp_ns", T.LongType()),
    T.StructField("exchange", T.StringType(), False),
    T.StructField("instrument_id", T.LongType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("stream_id", T.StringType(), False),
]
QUANTITIES = [T.StructField(f"quantity_{k}", DEC) for k in ("base", "quote", "contracts")]
TRADE = T.StructType(
    [
        *IDENTITY,
        T.StructField("trade_id", T.StringType()),
        T.StructField("sequence", T.DecimalType(20, 0)),
        T.StructField("side", T.StringType(), False),
        T.StructField("price", DEC, False),
        *QUANTITIES,
        T.StructField("is_rpi", T.BooleanType()),
        *[T.StructField(k, DEC) for k in ("trade_iv", "mark_iv", "index_price", "mark_price")],
    ]
)
LEVEL = T.StructType([T.StructField("side", T.StringType(), False), T.StructField("price", DEC, False), *QUANTITIES, T.StructField("order_count", T.DecimalType(20, 0))])
DEPTH_LEVEL = T.StructType([*IDENTITY, *LEVEL.fields])
DEPTH_EVENT = T.StructType(
    [
        T.StructField("event_ordinal", T.LongType(), False),
        T.StructField("canonical_row_offset", T.LongType(), False),
        T.StructField("canonical_row_count", T.LongType(), False),
        T.StructField("event_timestamp_ns", T.LongType(), False),
        T.StructField("system_timestamp_ns", T.LongType()),
        T.StructField("sequence_start", T.LongType()),
        T.StructField("sequence_end", T.LongType()),
        T.StructField("event_boundary", T.ShortType(), False),
        T.StructField("source_operation", T.ShortType(), False),
    ]
)

# Codes of stored columns.
BOUNDARY = {"changes": 0, "initialization": 1}
OPERATION = {"snapshot": 0, "absolute": 1, "relative": 2, "bounded": 3}
EVENT_KIND = {"trade": 0, "depth": 1}
STATUS = {"identity": 0, "converted": 1, "unavailable": 2, "skipped": 3}
FAILURE = {"missing": 1, "stale": 2, "future": 3, "identity_mismatch": 4, "arithmetic": 5, "no_path": 6}
EXCHANGE_PATTERN = "^[a-z][a-z0-9_]{0,31}$"
NS_PER_HOUR, NS_PER_DAY = 3_600_000_000_000, 86_400_000_000_000
