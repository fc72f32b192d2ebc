"""Streams: event-time merge with bounded lateness, bounded duplicate checks, gaps and tumbling counters.

The state machines are plain Python classes; ``merge_stream`` runs one in a stateful streaming query.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class StreamFailure(RuntimeError):
    """A terminal failure: late or disordered input, or a full state."""


class OrderedMerge:
    """Event-time merge: a head goes out once every input's watermark (its highest time less the lateness) lies above its time."""

    def __init__(self, inputs: list[str], lateness: int, most: int = 1_000_000):
        self.inputs, self.lateness, self.most = inputs, lateness, most
        self.high: dict[str, int] = {}
        self.pending: list[list] = []
        self.frontier: list | None = None
        self.ended = False

    def add(self, source: str, time: int | None, ordinal: int, payload: str) -> None:
        if time is None:  # an untimed baseline sorts before everything, and only before ordered data
            if source in self.high:
                raise StreamFailure(f"{source}: an untimed record after ordered ones")
            time = -(1 << 62)
        elif time < self.high.get(source, time) - self.lateness:
            raise StreamFailure(f"{source}: {time} is later than the lateness allows")
        else:
            self.high[source] = max(time, self.high.get(source, time))
        key = [time, self.inputs.index(source), ordinal, payload]
        if self.frontier is not None and key[:3] < self.frontier:
            raise StreamFailure(f"{source}: {time} is below what went out")
        self.pending.append(key)
        if len(self.pending) > self.most:
            raise StreamFailure(f"more than {self.most} records are pending")

    def ready(self) -> list[tuple[int, str, int, str]]:
        self.pending.sort()
        mark = min((self.high[s] - self.lateness for s in self.inputs), default=0) if all(s in self.high for s in self.inputs) else None
        n = len(self.pending) if self.ended else 0 if mark is None else sum(p[0] < mark for p in self.pending)
        out, self.pending = self.pending[:n], self.pending[n:]
        if out:
            self.frontier = out[-1][:3]
        return [(t, self.inputs[i], o, p) for t, i, o, p in out]

    def finish(self) -> list[tuple[int, str, int, str]]:
        self.ended = True
        return self.ready()

    def dump(self) -> str:
        return json.dumps([self.high, self.pending, self.frontier])

    @classmethod
    def load(cls, inputs: list[str], lateness: int, most: int, state: str | None) -> OrderedMerge:
        out = cls(inputs, lateness, most)
        if state:
            out.high, out.pending, out.frontier = json.loads(state)
        return out


def merge_stream(stream: DataFrame, inputs: list[str], lateness: int, most: int = 1_000_000) -> DataFrame:
    """(merge_id, position, ts, source, ordinal, payload) of a stream (merge_id, ts, source, ordinal, payload, is_end).

    A row with is_end completes its merge and flushes the tail. Late input fails the query; it isn't dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        merge = OrderedMerge.load(inputs, lateness, most, held[0] if held else None)
        position = held[1] if held else 0
        rows: list[tuple] = []
        for batch in batches:
            for r in batch.sort_values(["ordinal"]).itertuples():
                if r.is_end:
                    merge.ended = True
                else:
                    merge.add(r.source, None if pd.isna(r.ts) else int(r.ts), int(r.ordinal), r.payload)
        for t, source, ordinal, payload in merge.ready():
            rows.append((key[0], position, t, source, ordinal, payload))
            position += 1
        state.update((merge.dump(), position))
        yield pd.DataFrame(rows, columns=["merge_id", "position", "ts", "source", "ordinal", "payload"])

    return stream.groupBy("merge_id").applyInPandasWithState(run, "merge_id string, position long, ts long, source string, ordinal long, payload string", "state string, position long", "append", GroupStateTimeout.NoTimeout)


class RecentIds:
    """Duplicates among the last ``capacity`` ids; a batch is taken whole or not at all."""

    def __init__(self, capacity: int):
        self.capacity, self.ids = capacity, OrderedDict()

    def admit(self, batch: list[str]) -> list[bool]:
        """Whether each id is new within the window, the batch's own ids included."""
        if len(batch) > self.capacity:
            raise StreamFailure("a batch is larger than the window")
        out, own = [], set()
        for i in batch:
            out.append(i not in self.ids and i not in own)
            own.add(i)
        for i, new in zip(batch, out, strict=True):
            if new:
                self.ids[i] = None
        while len(self.ids) > self.capacity:
            self.ids.popitem(last=False)
        return out


class TradeGaps:
    """Numeric ids: regressions and gaps against the highest id so far."""

    def __init__(self) -> None:
        self.high: int | None = None

    def add(self, trade_id: int) -> str:
        high, self.high = self.high, trade_id if self.high is None else max(self.high, trade_id)
        if high is None or trade_id == high + 1:
            return "contiguous"
        return "duplicate" if trade_id == high else "regression" if trade_id < high else "gap"


class DepthContinuity:
    """Buffered deltas until a snapshot, its bridge, then gapless ranges; a gap invalidates the book until the next snapshot."""

    def __init__(self, most: int = 10_000):
        self.most, self.last, self.buffer, self.generation = most, None, [], 0

    def snapshot(self, sequence: int) -> list[tuple[int, int]]:
        """Takes a snapshot; returns the buffered deltas that apply after it."""
        self.last, self.generation = sequence, self.generation + 1
        held, self.buffer = self.buffer, []
        applied = []
        for first, last in held:
            if self.delta(first, last) == "applied":
                applied.append((first, last))
        return applied

    def delta(self, first: int, last: int) -> str:
        if self.last is None:
            self.buffer.append((first, last))
            if len(self.buffer) > self.most:
                raise StreamFailure("too many deltas before a snapshot")
            return "buffered"
        if last <= self.last:
            return "stale"
        if first > self.last + 1:
            self.last, self.buffer = None, [(first, last)]
            return "gap"
        self.last = last
        return "applied"


def tumbling_counts(stream: DataFrame, time: str, lateness: str, width: str, by: list[str]) -> DataFrame:
    """Counts a window of event time, for finite or endless streams."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), *by, "events")


def unique_within(stream: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
