"""Validation with counted categories, identity policies, tumbling counters and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import window_start
from ..schema import NS_PER_DAY, NS_PER_HOUR


def categorize(df: DataFrame, rules: dict[str, Column], out: str = "error_category") -> DataFrame:
    """Adds the first category whose condition holds, null for valid rows; a null condition doesn't hold. No row is dropped."""
    branch = reduce(lambda acc, kv: F.coalesce(F.when(kv[1], F.lit(kv[0])), acc), reversed(list(rules.items())), F.lit(None).cast("string"))
    return df.withColumn(out, branch)


def trade_rules() -> dict[str, Column]:
    quantities = [F.col(f"quantity_{k}") for k in ("base", "quote", "contracts")]
    return {
        "missing_identity": F.coalesce(F.trim("symbol"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("instrument_id") <= 0, F.lit(True)),
        "invalid_price": F.coalesce(F.col("price") <= 0, F.lit(True)),
        "missing_quantity": F.coalesce(*quantities).isNull(),
        "invalid_quantity": reduce(lambda a, b: a | b, [F.coalesce(q <= 0, F.lit(False)) for q in quantities]),
        "invalid_side": ~F.coalesce(F.col("side").isin("buy", "sell", "unknown"), F.lit(False)),
    }


def level_rules() -> dict[str, Column]:
    quantities = [F.col(f"quantity_{k}") for k in ("base", "quote", "contracts")]
    some = lambda f: reduce(lambda a, b: a | b, [F.coalesce(f(q), F.lit(False)) for q in quantities])
    return {
        "invalid_price": F.coalesce(F.col("price") <= 0, F.lit(True)),
        "missing_quantity": F.coalesce(*quantities).isNull(),
        "invalid_quantity": some(lambda q: q < 0),
        "mixed_zero": some(lambda q: q == 0) & some(lambda q: q > 0),
    }


def identity_policy(df: DataFrame, expected: Column, policy: str) -> DataFrame:
    """strict marks other contracts as identity_mismatch, filter marks them as filtered, trust_source leaves them."""
    if policy == "trust_source":
        return df.withColumn("identity_outcome", F.lit("accepted"))
    other = {"strict": "identity_mismatch", "filter": "filtered"}[policy]
    return df.withColumn("identity_outcome", F.when(F.coalesce(expected, F.lit(False)), "accepted").otherwise(other))


def route_family(df: DataFrame, instruments: DataFrame, symbol: str = "symbol") -> DataFrame:
    """One read for many instruments: (symbol, instrument_id, in_scope) is joined and each row gets a route; counts are a groupBy away."""
    known = instruments.select(F.col("symbol").alias("__symbol"), "instrument_id", "in_scope")
    route = F.when(F.col("__symbol").isNull(), "missing_metadata").when(~F.col("in_scope"), "outside_scope").otherwise("routed")
    return df.join(known, F.col(symbol) == F.col("__symbol"), "left").withColumn("route", route).drop("__symbol", "in_scope")


def one_rule(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the name of the one rule that matches; rows that match none or several get null and their number of matches."""
    n = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in rules.values()])
    name = F.coalesce(*[F.when(c, F.lit(k)) for k, c in rules.items()])
    return df.withColumn("matches", n).withColumn("rule", F.when(n == 1, name))


def counters(df: DataFrame, scope: list[str], category: str = "error_category") -> DataFrame:
    """eligible rows and violations of each category by scope."""
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("eligible"), F.count(category).alias("violations"))


def windowed_counters(df: DataFrame, scope: list[str], width: int = NS_PER_HOUR, time: str = "event_timestamp_ns") -> DataFrame:
    return counters(df.withColumn("window_start", window_start(F.col(time), width)), [*scope, "window_start"])


def evaluate(counted: DataFrame, max_count: int | None = None, max_rate: float | None = None, minimum_samples: int = 1) -> DataFrame:
    """clean, degraded or failed: exceeded only above max_count, or above eligible * max_rate with samples enough, compared exactly."""
    failed = F.lit(False)
    if max_count is not None:
        failed = failed | (F.col("violations") > max_count)
    if max_rate is not None:
        failed = failed | ((F.col("eligible") >= minimum_samples) & (F.col("violations").cast("decimal(20,0)") > F.col("eligible").cast("decimal(20,0)") * F.lit(str(max_rate)).cast("decimal(13,12)")))
    return counted.withColumn("outcome", F.when(failed, "failed").when(F.col("violations") > 0, "degraded").otherwise("clean"))


def by_day(df: DataFrame, scope: list[str]) -> DataFrame:
    return windowed_counters(df, scope, NS_PER_DAY)
