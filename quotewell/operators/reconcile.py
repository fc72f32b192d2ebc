"""Reconciling overlapping sources: identities, order, coverage and ownership of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import native_id_order


class IdentityConflict(ValueError):
    """Rows of one identity differ in content."""


def reconcile_trades(rows: DataFrame, identity: list[str], precedence: list[str], content: list[str]) -> DataFrame:
    """Every row with its outcome: winner, duplicate (equal content) or conflict.

    The first row by ``precedence`` wins an identity; conflicts are the caller's to count or to raise.
    """
    w = Window.partitionBy(*identity).orderBy(*precedence)
    body = F.struct(*content)
    first = F.first(body).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.row_number().over(w) == 1, "winner").when(body.eqNullSafe(first), "duplicate").otherwise("conflict")
    return rows.withColumn("outcome", outcome)


def winners(reconciled: DataFrame, strict: bool = True) -> DataFrame:
    """The winning rows. A strict run fails on any conflict."""
    if strict and reconciled.where("outcome = 'conflict'").limit(1).count():
        raise IdentityConflict("rows of one identity differ in content")
    return reconciled.where("outcome = 'winner'").drop("outcome")


def id_reliable(exchange: Column, scope: Column, trade_id: Column) -> Column:
    """Whether a trade id identifies a trade across sources, by the profile's scope, else by what the exchange is known for; a null id never does."""
    uuid = trade_id.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    known = F.when(exchange.isin("binance", "okx"), True).when(exchange == "bybit", uuid).otherwise(False)
    return F.when(trade_id.isNull(), False).when(scope.isin("global", "instrument", "ordered_run"), True).when(scope.isin("source_local", "unreliable"), False).otherwise(F.coalesce(known, F.lit(False)))


def observe(rows: DataFrame, source: list[str], order: list[str], time: str = "event_timestamp_ns", ident: str = "trade_id") -> DataFrame:
    """A summary of each source: times, ids and whether its times never fall in its own order."""
    w = Window.partitionBy(*source).orderBy(*order)
    falls = F.col(time) < F.lag(time).over(w)
    return (
        rows.withColumn("__falls", F.coalesce(falls, F.lit(False)))
        .groupBy(*source)
        .agg(
            F.min(time).alias("min_ts"),
            F.max(time).alias("max_ts"),
            F.min_by(time, F.struct(*order)).alias("first_ts"),
            F.max_by(time, F.struct(*order)).alias("last_ts"),
            F.min_by(ident, F.struct(*order)).alias("first_id"),
            F.max_by(ident, F.struct(*order)).alias("last_id"),
            F.count(F.lit(1)).alias("records"),
            (~F.bool_or("__falls")).alias("ordered"),
        )
    )


def appendable(observed: DataFrame, stream: list[str]) -> DataFrame:
    """Whether the sources of a stream are disjoint in time, so that they append without reconciliation. Sources are few."""
    w = Window.partitionBy(*stream).orderBy("min_ts", "max_ts")
    return observed.withColumn("__ok", F.coalesce(F.col("max_ts") < F.lead("min_ts").over(w), F.lit(True))).groupBy(*stream).agg(F.bool_and("__ok").alias("appendable"))


def ordered_run(rows: DataFrame, stream: list[str], time: str = "event_timestamp_ns", ident: str = "trade_id") -> DataFrame:
    """Whether numeric ids rise strictly in the order of (time, id)."""
    key = native_id_order(F.col(ident))
    w = Window.partitionBy(*stream).orderBy(time, key)
    return rows.withColumn("__ok", F.coalesce(F.lag(key).over(w) < key, F.lit(True))).groupBy(*stream).agg(F.bool_and("__ok").alias("ordered_run"))


def regressions(rows: DataFrame, stream: list[str], order: list[str], time: str = "event_timestamp_ns") -> DataFrame:
    """Adds whether a time is below the one before, and how far it is below the highest before."""
    w = Window.partitionBy(*stream).orderBy(*order)
    high = F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("regressed", F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False))).withColumn("regression_ns", F.greatest(F.coalesce(high - F.col(time), F.lit(0)), F.lit(0)))


def apply_regression_policy(rows: DataFrame, policy: str, permitted_ns: int = 0) -> DataFrame:
    """``rows`` from regressions(): strict raises, discard drops rows beyond what is permitted, preserve and reorder keep all."""
    beyond = F.col("regression_ns") > permitted_ns
    if policy == "strict" and rows.where(beyond).limit(1).count():
        raise ValueError("a timestamp regresses by more than permitted")
    return rows.where(~beyond) if policy == "discard" else rows


def islands(intervals: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching or overlapping intervals [start, end) merged."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) > before, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.withColumn("__island", island).groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(covered: DataFrame, key: list[str], low: int, high: int, start: str = "start", end: str = "end") -> DataFrame:
    """The parts of [low, high) that islands leave open, for each key that has any."""
    inside = covered.where((F.col(end) > low) & (F.col(start) < high)).select(*key, F.greatest(F.col(start), F.lit(low)).alias(start), F.least(F.col(end), F.lit(high)).alias(end))
    edges = covered.select(*key).distinct().select(*key, F.lit(low).alias(start), F.lit(low).alias(end)).unionByName(inside)
    w = Window.partitionBy(*key).orderBy(start, end)
    until = F.coalesce(F.lead(start).over(w), F.lit(high))
    return edges.withColumn("gap_end", until).where(F.col(end) < F.col("gap_end")).select(*key, F.col(end).alias("gap_start"), "gap_end")


def overlapping(intervals: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Whether any two intervals of a key overlap."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("__over", F.coalesce(F.col(start) < before, F.lit(False))).groupBy(*key).agg(F.bool_or("__over").alias("overlapping"))


def ownership(sources: DataFrame, key: list[str], rank: str = "rank", start: str = "start", end: str = "end") -> DataFrame:
    """Who owns which time: the lowest rank that covers an elementary interval, neighbours of one owner joined. Sources are few."""
    points = sources.select(*key, F.explode(F.array(start, end)).alias("at")).distinct()
    w = Window.partitionBy(*key).orderBy("at")
    pieces = points.withColumn("until", F.lead("at").over(w)).where("until is not null")
    held = pieces.join(sources.select(*key, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(rank).alias("owner")), key).where((F.col("__s") <= F.col("at")) & (F.col("until") <= F.col("__e")))
    owned = held.groupBy(*key, "at", "until").agg(F.min("owner").alias("owner"))
    w = Window.partitionBy(*key).orderBy("at")
    new = F.when((F.lag("owner").over(w) == F.col("owner")) & (F.lag("until").over(w) == F.col("at")), 0).otherwise(1)
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return owned.withColumn("__new", new).withColumn("__run", run).groupBy(*key, "__run").agg(F.min("at").alias("start"), F.max("until").alias("end"), F.first("owner").alias("owner")).drop("__run")


def exclusion_spans(rows: DataFrame, stream: list[str], order: list[str], excluded: Column, time: str = "event_timestamp_ns") -> DataFrame:
    """Runs of excluded rows in order, with their number and span."""
    w = Window.partitionBy(*stream).orderBy(*order)
    run = F.sum(F.when(excluded, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", run).where(excluded).groupBy(*stream, "__run").agg(F.count(F.lit(1)).alias("rows"), (F.max(time) - F.min(time)).alias("span_ns")).drop("__run")
