"""Market statistics: latest observations, volumes, rankings, currency legs, upserts and ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(observations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest observation of each key, by ``order`` from high to low; partial aggregation keeps one row a key and task."""
    return observations.groupBy(*key).agg(F.max_by(F.struct(*[c for c in observations.columns if c not in key]), F.struct(*order)).alias("o")).select(*key, "o.*")


def volume_measure(base: Column, contracts: Column, face: Column, quote_face: Column, price: Column) -> tuple[Column, Column]:
    """(base quantity, how it is known): reported, contracts by face value, or estimated by price; else why it is unknown."""
    by_face = contracts * face
    estimated = F.try_divide(contracts * quote_face, price)
    value = F.coalesce(F.when(base > 0, base), F.when(by_face > 0, by_face), F.when(estimated > 0, estimated))
    how = F.when(base > 0, "base_volume").when(by_face > 0, "contracts").when(estimated > 0, "estimated").when(price.isNull(), "no_price").otherwise("no_volume")
    return value, how


def exclusions(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """The first reason that holds, null where none does."""
    return rows.withColumn("reason", F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()], F.lit(None).cast("string")))


def rank(rows: DataFrame, score: str, reference: str, preference: str | None = None, group: str | None = None) -> DataFrame:
    """position over all included rows, by manual preference, score from high to low, reference; group_position within a group.

    Instruments are few: one sort holds them. Excluded rows (with a reason) follow, unranked.
    """
    keys = [*([F.col(preference).asc_nulls_last()] if preference else []), F.desc(score), F.col(reference)]
    kept = rows.where("reason is null").withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    if group:
        kept = kept.withColumn("group_position", F.row_number().over(Window.partitionBy(group).orderBy(*keys)).cast("long"))
    return kept.unionByName(rows.where("reason is not null"), allowMissingColumns=True)


def dense_ranks(rows: DataFrame, position: str) -> DataFrame:
    return rows.withColumn("stream_rank", F.dense_rank().over(Window.orderBy(position)) - 1)


def freshest(rows: DataFrame, now: int, skew: int, group: str | None = None, time: str = "window_end") -> DataFrame:
    """Adds the newest time that isn't beyond now + skew, over all rows or a group, and each row's lag behind it."""
    seen = F.when(F.col(time) <= now + skew, F.col(time))
    if group is None:
        top = rows.agg(F.max(seen).alias("group_time"))
        out = rows.crossJoin(F.broadcast(top))  # one row
    else:
        out = rows.withColumn("group_time", F.max(seen).over(Window.partitionBy(group)))
    return out.withColumn("lag", F.col("group_time") - F.col(time))


def ambiguous(instruments: DataFrame, identity: list[str], ident: str) -> DataFrame:
    """Whether another id has the same identity."""
    return instruments.withColumn("ambiguous", F.size(F.collect_set(ident).over(Window.partitionBy(*identity))) > 1)


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], newer: list[str]) -> DataFrame:
    """Incoming rows replace stored ones unless those are newer; at equal times the incoming row wins."""
    both = stored.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*newer, "__in")).alias("r")).select(*key, "r.*").select(*stored.columns)


def currency_legs(edges: DataFrame, source: str, target: str, preferred: list[str], bridges: list[str]) -> DataFrame:
    """Direct or one-bridge routes from source to target on one venue, best first.

    Edges: venue, base, quote, price, at. Order: fewer legs, preferred venue, the newer weakest leg, preferred bridge, names.
    """
    both = edges.select("venue", F.col("base").alias("a"), F.col("quote").alias("b"), F.col("price").alias("rate"), "at").unionByName(edges.select("venue", F.col("quote").alias("a"), F.col("base").alias("b"), F.try_divide(F.lit(1.0), "price").alias("rate"), "at"))
    pos = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)), F.lit(len(names) + 1)) if names else F.lit(1)
    direct = both.where((F.col("a") == source) & (F.col("b") == target)).select("venue", F.lit(None).cast("string").alias("bridge"), "rate", "at", F.lit(1).alias("legs"))
    first = both.where((F.col("a") == source) & (F.col("b") != target)).select("venue", F.col("b").alias("bridge"), F.col("rate").alias("r1"), F.col("at").alias("t1"))
    second = both.where((F.col("b") == target) & (F.col("a") != source)).select("venue", F.col("a").alias("bridge"), F.col("rate").alias("r2"), F.col("at").alias("t2"))
    bridged = first.join(second, ["venue", "bridge"]).select("venue", "bridge", (F.col("r1") * F.col("r2")).alias("rate"), F.least("t1", "t2").alias("at"), F.lit(2).alias("legs"))
    order = Window.orderBy("legs", pos(F.col("venue"), preferred), F.desc("at"), pos(F.col("bridge"), bridges), "venue", F.col("bridge").asc_nulls_first())
    return direct.unionByName(bridged).withColumn("choice", F.row_number().over(order).cast("long"))


def same_venue_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")


def bridge_rest(live: DataFrame, rest: DataFrame, baseline: int, trigger: int) -> tuple[DataFrame, DataFrame]:
    """Live and REST trades by numeric id, and the ids in (baseline, trigger] that neither has or that differ: those fail the bridge."""
    want = live.sparkSession.range(baseline + 1, trigger + 1).withColumnRenamed("id", "trade_id")
    both = live.select("trade_id", F.struct("price", "quantity").alias("l")).join(rest.select("trade_id", F.struct("price", "quantity").alias("r")), "trade_id", "full_outer")
    failed = want.join(both, "trade_id", "left").where("r is null or (l is not null and not (l <=> r))").select("trade_id")
    return both.select("trade_id", F.coalesce("l", "r").alias("t")).select("trade_id", "t.*"), failed
