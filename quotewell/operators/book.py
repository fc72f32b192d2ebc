"""Order books: continuity, segments, levels as of an event, snapshots and boundaries.

Rows are levels or events with a stream, an order (``ordinal``) and, where they start a state, ``is_init``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(stream: list[str], order: str) -> Window:
    return Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segments(events: DataFrame, stream: list[str], order: str = "ordinal", init: str = "is_init", levels: str = "level_count") -> DataFrame:
    """segment_id counts from 0 at the first initialization (null before any), row_offset is the levels before."""
    opened = F.sum(F.col(init).cast("long")).over(_upto(stream, order))
    before = F.sum(levels).over(Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("segment_id", F.when(opened > 0, opened - 1)).withColumn("row_offset", F.coalesce(before, F.lit(0)))


def continuity(events: DataFrame, stream: list[str], kind: str = "ranged", order: str = "ordinal", init: str = "is_init") -> DataFrame:
    """accepted, gap, or missing_snapshot from a gap to the next initialization and before the first one.

    consecutive: sequence_end is one more than the last; ranged: sequence_start is; unsequenced: nothing is checked.
    """
    w = Window.partitionBy(*stream).orderBy(order)
    want = F.lag("sequence_end").over(w) + 1
    first = F.col("sequence_end") if kind == "consecutive" else F.col("sequence_start")
    gap = F.lit(False) if kind == "unsequenced" else F.coalesce(~F.col(init) & (first != want), F.lit(False))
    seg = F.sum(F.col(init).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = events.withColumn("__gap", gap).withColumn("__seg", seg)
    broken = F.max(F.col("__gap").cast("int")).over(Window.partitionBy(*stream, "__seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    state = F.when((F.col("__seg") == 0) | (F.coalesce(broken, F.lit(0)) == 1), "missing_snapshot").when(F.col("__gap"), "gap").otherwise("accepted")
    return marked.withColumn("continuity", state).drop("__gap", "__seg")


def book_at(levels: DataFrame, book: list[str], order: str = "ordinal", quantity: str = "quantity") -> DataFrame:
    """The last state of each (side, price) of a book; zero is absence."""
    last = levels.groupBy(*book, "side", "price").agg(F.max_by(quantity, order).alias(quantity))
    return last.where(F.col(quantity) > 0)


def changes_only(levels: DataFrame, book: list[str], order: str = "ordinal", quantity: str = "quantity") -> DataFrame:
    """Without updates that leave a level as it is, deletes of absent levels included."""
    before = F.coalesce(F.lag(quantity).over(Window.partitionBy(*book, "side", "price").orderBy(order)), F.lit(0))
    return levels.withColumn("__before", before).where(F.col("__before") != F.col(quantity)).drop("__before")


def repeated_levels(levels: DataFrame, event: list[str]) -> DataFrame:
    """(event, side, price) that one message sets more than once: an error of the whole message."""
    return levels.groupBy(*event, "side", "price").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relative_to_absolute(levels: DataFrame, book: list[str], order: str = "ordinal", delta: str = "delta", seed: str = "is_seed") -> DataFrame:
    """Running quantities from signed changes, seeded by snapshot rows; a negative state is marked invalid.

    Streams with an invalid row need its removal before: a rejected change must not enter the sum.
    """
    lots = F.sum(F.col(seed).cast("long")).over(Window.partitionBy(*book, "side", "price").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    seeded = levels.withColumn("__lot", lots)
    total = F.sum(delta).over(Window.partitionBy(*book, "side", "price", "__lot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return seeded.withColumn("quantity", total).withColumn("invalid", F.col("quantity") < 0).drop("__lot")


def apply_changes(levels: DataFrame, book: list[str], order: str = "ordinal", delta: str = "delta", seed: str = "is_seed") -> DataFrame:
    """Adds lot (seeds so far), quantity after each signed change, and rejected: a change below nothing enters no later sum.

    Lots whose plain running sum never falls below zero are that sum. Only the others are worked through in order, as streams of sorted
    rows with one state, so that a lot of any length needs no more memory.
    """
    key = [*book, "side", "price"]
    lots = F.coalesce(F.sum(F.col(seed).cast("long")).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    seeded = levels.withColumn("lot", lots)
    total = F.sum(delta).over(Window.partitionBy(*key, "lot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    summed = seeded.withColumn("quantity", total.cast(levels.schema[delta].dataType))
    summed = summed.withColumn("__low", F.min("quantity").over(Window.partitionBy(*key, "lot"))).withColumn("rejected", F.lit(False))
    fine = summed.where("__low >= 0").drop("__low")
    rest = summed.where("__low < 0").drop("__low").withColumn("__k", F.xxhash64(*key, "lot"))
    kind = fine.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        for batch in batches:
            quantity, rejected = [], []
            for k, d in zip(batch["__k"].to_pylist(), batch[delta].to_pylist(), strict=True):
                if k != last:
                    last, state = k, 0
                bad = d is not None and state + d < 0
                state = state if bad or d is None else state + d
                quantity.append(state)
                rejected.append(bad)
            made = {"quantity": pa.array(quantity, batch["quantity"].type), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch[n] for n in kind.names], kind.names)

    return fine.unionByName(rest.repartition(*key).sortWithinPartitions(*key, "lot", order).mapInArrow(run, kind))


def assemble_snapshots(rows: DataFrame, stream: list[str], order: str = "ordinal", snapshot: str = "is_snapshot") -> DataFrame:
    """Consecutive snapshot rows as one snapshot, valid if one time and sequence cover both sides."""
    w = Window.partitionBy(*stream).orderBy(order)
    other = F.sum(F.when(F.col(snapshot), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = F.struct(order, "side", "price", "quantity")
    out = rows.withColumn("__run", other).where(F.col(snapshot)).groupBy(*stream, "__run")
    out = out.agg(F.min(order).alias("first_ordinal"), F.sort_array(F.collect_list(level)).alias("levels"), F.min("ts").alias("ts"), (F.min("ts").eqNullSafe(F.max("ts")) & F.min("sequence").eqNullSafe(F.max("sequence"))).alias("one"), (F.count_distinct("side") == 2).alias("both"))
    return out.withColumn("valid", F.col("one") & F.col("both")).drop("__run", "one", "both")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], quantity: str = "quantity") -> DataFrame:
    """Absolute updates that turn one book into the other: gone levels as zero, new and changed ones with their quantity."""
    a = old.select(*key, "side", "price", F.col(quantity).alias("__old"))
    b = new.select(*key, "side", "price", F.col(quantity).alias("__new"))
    both = a.join(b, [*key, "side", "price"], "full_outer")
    return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(*key, "side", "price", F.coalesce("__new", F.lit(0)).alias(quantity))


def bounded_observation(events: DataFrame, stream: list[str], per_side: int, order: str = "ordinal") -> DataFrame:
    """Whether an observation has at most ``per_side`` levels a side and a sequence that doesn't fall."""
    falls = F.col("sequence_end") < F.lag("sequence_end").over(Window.partitionBy(*stream).orderBy(order))
    small = (F.col("bid_count") <= per_side) & (F.col("ask_count") <= per_side)
    return events.withColumn("valid", small & ~F.coalesce(falls, F.lit(False)))


def dependency_prefix(events: DataFrame, stream: list[str], in_range: Column, order: str = "ordinal", segment: str = "segment_id") -> DataFrame:
    """From a segment's start to its last event in range; earlier events than the range are marked reconstruction_only."""
    last = F.max(F.when(in_range, F.col(order))).over(Window.partitionBy(*stream, segment))
    return events.withColumn("__last", last).where(F.col(order) <= F.col("__last")).withColumn("reconstruction_only", ~in_range).drop("__last")


def latest_checkpoint(checkpoints: DataFrame, key: list[str], at: int, time: str = "ts") -> DataFrame:
    return checkpoints.where(F.col(time) <= at).groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(time, "ordinal")).alias("c")).select("c.*")


def fingerprints(levels: DataFrame, book: list[str], quantity: str = "quantity") -> DataFrame:
    """SHA-256 of a book's levels, sorted by side and price."""
    text = F.concat_ws("|", "side", F.col("price").cast("string"), F.col(quantity).cast("string"))
    return levels.groupBy(*book).agg(F.sort_array(F.collect_list(F.struct("side", "price", text.alias("t")))).alias("l"), F.count(F.lit(1)).alias("levels")).select(*book, "levels", F.sha2(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), 256).alias("fingerprint"))


def boundary_relation(tasks: DataFrame, dataset: list[str]) -> DataFrame:
    """How a task follows the one before: verified, state_mismatch, gap, independent or unverifiable.

    Tasks have first_ts, initial and final fingerprints, and sequences; tasks are few.
    """
    w = Window.partitionBy(*dataset).orderBy("first_ts")
    state, end = F.lag("final_fingerprint").over(w), F.lag("sequence_end").over(w)
    known = F.col("sequence_start").isNotNull() & end.isNotNull()
    relation = F.when(F.row_number().over(w) == 1, "independent").when(known & (F.col("sequence_start") > end + 1), "gap").when(state.isNull() | F.col("initial_fingerprint").isNull(), "unverifiable").when(state == F.col("initial_fingerprint"), "verified").otherwise("state_mismatch")
    return tasks.withColumn("relation", relation)


def continuity_class(df: DataFrame, source: list[str], discontinuity: Column, complete: Column, sequenced: Column) -> DataFrame:
    broken, whole, known = F.bool_or(discontinuity), F.max_by(complete, "ordinal"), F.bool_and(sequenced)
    return df.groupBy(*source).agg(F.when(broken & whole, "recovered_from_snapshot").when(broken, "gap_detected").when(known & whole, "verified").otherwise("unverifiable").alias("continuity_class"))
