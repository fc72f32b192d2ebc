"""Merging ranked streams into one totally ordered timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["event_timestamp_ns", "stream_rank", "task_rank", "event_ordinal"]


def union_streams(streams: list[DataFrame]) -> DataFrame:
    """All streams with nulls for columns that one lacks; each carries its own rank."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def _with_high(events: DataFrame, last: int, bucket: int) -> DataFrame:
    """Adds __high: the highest time of a stream from its first event to the one ``last`` places on, in its own order.

    A stream may hold most events, so it is cut into buckets of ``bucket`` ordinals of a task: the maxima of the buckets, a row each, are
    carried along the stream, and only a bucket is ever one window.
    """
    parts = ["stream_rank", "task_rank", "__bucket"]
    placed = events.withColumn("__bucket", F.floor(F.col("event_ordinal") / bucket))
    before = F.max("__top").over(Window.partitionBy("stream_rank").orderBy("task_rank", "__bucket").rowsBetween(Window.unboundedPreceding, -1))
    tops = placed.groupBy(*parts).agg(F.max("event_timestamp_ns").alias("__top")).withColumn("__before", before)
    carried = tops.where("__before is not null").select(*[F.col(c).alias(f"__of_{c}") for c in parts], "__before")
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in parts]
    inside = F.max("event_timestamp_ns").over(Window.partitionBy(*parts).orderBy("event_ordinal").rowsBetween(Window.unboundedPreceding, last))
    return placed.withColumn("__high", inside).join(carried, same, "left").withColumn("__high", F.greatest("__high", "__before")).select(*events.columns, "__high")


def regressions(events: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Events whose time is below an earlier one of their stream, by source order."""
    return _with_high(events, -1, bucket).where("event_timestamp_ns < __high").drop("__high")


def chronological(events: DataFrame, on_regression: str = "fail", bucket: int = 1 << 20) -> DataFrame:
    """Ordered by (time, stream, task, ordinal); a stream that regresses fails, or loses those events (drop)."""
    if on_regression == "fail":
        if regressions(events, bucket).limit(1).count():
            raise ValueError("a stream regresses in time")
        return events.orderBy(*KEY)
    return _with_high(events, -1, bucket).where("__high is null or event_timestamp_ns >= __high").drop("__high").orderBy(*KEY)


def causal_key(events: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Adds merge_time: the highest time of a stream so far, in its own order. Sorting by (merge_time, rank, task, ordinal) equals
    taking, again and again, the available head with the smallest (time, rank)."""
    return _with_high(events, 0, bucket).withColumnRenamed("__high", "merge_time")


def causal(events: DataFrame) -> DataFrame:
    return causal_key(events).orderBy("merge_time", "stream_rank", "task_rank", "event_ordinal")


def with_sequence(events: DataFrame, order: list[str], out: str = "timeline_sequence") -> DataFrame:
    """A gapless position from 0 in a global order that starts with a number, without a single task.

    Ranges of the first key are cut at its approximate quantiles, so they are fixed numbers however often the plan runs; a
    position is the rows of the ranges before and the rank within the range.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in events.approxQuantile(order[0], [i / n for i in range(1, n)], 0.25 / n)})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = events.withColumn("__range", F.size(F.filter(bounds, lambda c: c <= F.col(order[0]))))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # one row a range: a window without partitions is as small as the number of ranges
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__range").withColumn(out, (F.col("__start") + F.col("__rank")).cast("long")).drop("__range", "__rank", "__start")


def time_partitions(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """n equal slices of [low, high), the remainder spread over the first ones."""
    each, more = divmod(high - low, n)
    cuts = [low]
    for i in range(n):
        cuts.append(cuts[-1] + each + (i < more))
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def partition_inputs(partitions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Which tasks (first_ts to last_ts, both inclusive) reach into which slices [low, high). Slices are few and broadcast."""
    return tasks.join(F.broadcast(partitions), (F.col("last_ts") >= F.col("low")) & (F.col("first_ts") < F.col("high")))


def nest_depth(events: DataFrame, levels: DataFrame, key: list[str]) -> DataFrame:
    """Events with their levels as ``changes``, in row order; events without levels get none."""
    body = F.struct("row", "side", "price", "quantity_base", "quantity_quote", "quantity_contracts", "order_count")
    nested = levels.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(body)), lambda x: x.dropFields("row")).alias("changes"))
    return events.join(nested, key, "left")


def combine(trades: DataFrame, depth: DataFrame, trade_fields: list[str], depth_fields: list[str], common: list[str]) -> DataFrame:
    """One schema for both kinds: event_kind, and a trade or a depth struct."""
    t = trades.select(*common, F.lit(0).cast("short").alias("event_kind"), F.struct(*trade_fields).alias("trade"))
    d = depth.select(*common, F.lit(1).cast("short").alias("event_kind"), F.struct(*depth_fields).alias("depth"))
    return t.unionByName(d, allowMissingColumns=True)


def skip_redundant_initializations(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Drops the initialization that opens a task whose boundary continues the one before; a state mismatch fails."""
    if relations.where("relation = 'state_mismatch'").limit(1).count():
        raise ValueError("a task starts from another book than the one before left")
    known = relations.select("stream_rank", "task_rank", (F.col("relation") == "verified").alias("__same"))
    first = F.row_number().over(Window.partitionBy("stream_rank", "task_rank").orderBy("event_ordinal")) == 1
    drop = F.col("is_init") & F.col("__first") & F.coalesce("__same", F.lit(False))
    return events.withColumn("__first", first).join(known, ["stream_rank", "task_rank"], "left").where(~drop).drop("__first", "__same")


def accounting(timeline: DataFrame, by: list[str]) -> DataFrame:
    return timeline.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.min("event_timestamp_ns").alias("first_ts"), F.max("event_timestamp_ns").alias("last_ts"))


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return not left.exceptAll(right).limit(1).count() and not right.exceptAll(left).limit(1).count()


def maximum_regression(timeline: DataFrame, order: Column | str = "timeline_sequence", bucket: int = 1 << 20) -> int:
    """The furthest that a time lies below an earlier one of a causal timeline: per bucket of the sequence, with carried maxima."""
    b = F.floor(F.col(order) / bucket)
    tops = timeline.groupBy(b.alias("b")).agg(F.max("event_timestamp_ns").alias("top"))
    before = tops.select("b", F.max("top").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    high = F.greatest(F.max("event_timestamp_ns").over(w), F.col("before"))
    r = timeline.withColumn("b", b).join(before, "b").select((high - F.col("event_timestamp_ns")).alias("r")).agg(F.max("r")).first()[0]
    return int(r or 0)
