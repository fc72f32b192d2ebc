"""Data-set handles: time and identity filters, head and batches, profiles and inventories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["event_timestamp_ns", "stream_id", "trade_id"]


def half_open(df: DataFrame, start: int | None, end: int | None, time: str = "event_timestamp_ns") -> DataFrame:
    """start <= time < end, pushed to the scan."""
    if start is not None:
        df = df.where(F.col(time) >= start)
    return df if end is None else df.where(F.col(time) < end)


def overlaps(df: DataFrame, start: int | None, end: int | None, low: str = "first_ts", high: str = "last_ts", contained: bool = False) -> DataFrame:
    """Envelopes with inclusive ends that meet [start, end), or lie in it."""
    if contained:
        return df.where((F.lit(start is None) | (F.col(low) >= F.lit(start))) & (F.lit(end is None) | (F.col(high) < F.lit(end))))
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(high) >= start)
    return df.where(keep if end is None else keep & (F.col(low) < end))


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality, or IN for lists; parameters that are None don't filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def any_member(df: DataFrame, members: str, **wanted: object) -> DataFrame:
    """Rows of which one nested member meets all conditions."""
    return df.where(F.exists(members, lambda m: F.forall(F.array(*[m[k] == F.lit(v) for k, v in wanted.items()]), lambda x: F.coalesce(x, F.lit(False)))))


@dataclass(frozen=True)
class Stream:
    """Rows of one or several streams of a data set, lazily."""

    frame: DataFrame
    order: list[str] = field(default_factory=lambda: list(ORDER))

    def scan(self, columns: list[str] | None = None, start: int | None = None, end: int | None = None, time: str = "event_timestamp_ns") -> DataFrame:
        df = half_open(self.frame, start, end, time)
        return df.select(*columns) if columns else df

    def head(self, n: int, **scan: object) -> DataFrame:
        return self.scan(**scan).orderBy(*self.order).limit(n)

    def prefix(self, rows: int, condition: Column) -> DataFrame:
        """A condition on the first ``rows`` rows only: the budget counts rows before the filter."""
        return self.frame.orderBy(*self.order).limit(rows).where(condition)

    def batches(self, **scan: object) -> Iterator[pa.Table]:
        """Arrow tables, a partition at a time on the driver."""
        df = self.scan(**scan)
        for row in df.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([_ipc(b)], pa.binary())], ["ipc"]) for b in it), "ipc binary").toLocalIterator():
            yield pa.ipc.open_stream(bytes(row["ipc"])).read_all()

    def select(self, **wanted: object) -> Stream:
        return Stream(matching(self.frame, **wanted), self.order)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, minimum, maximum, nulls, rows) in one pass; values as text."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).cast("string").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("minimum"), F.col(f"max_{c}").alias("maximum"), F.col(f"nulls_{c}").cast("long").alias("nulls"), F.col("rows")) for c in columns])).alias("p")).select("p.*")


def inventory(files: DataFrame, key: list[str]) -> DataFrame:
    """Per key: files, known bytes (null unless all are known), rows, and its source if it is one."""
    return files.groupBy(*key).agg(
        F.count(F.lit(1)).alias("files"),
        F.when(F.count(F.lit(1)) == F.count("bytes"), F.sum("bytes")).alias("bytes"),
        F.count_distinct("source", "kind").alias("sources"),
        F.when(F.count_distinct(F.lower("source")) == 1, F.min("source")).alias("source"),
        F.count_if(F.col("kind") == "F").alias("finals"),
        F.bool_or(F.col("bytes").isNull()).alias("incomplete"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def comparable(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same columns of the same types, in any order."""
    return {(f.name, f.dataType.simpleString()) for f in a.schema} == {(f.name, f.dataType.simpleString()) for f in b.schema}
