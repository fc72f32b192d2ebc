"""Packing token sequences: shortest pack first over the length histogram.

A document's ids are cut at every ``capacity`` ids; full pieces are sequences of their own. The rest, shorter than the
capacity, are packed by their lengths alone: the driver holds a histogram of at most capacity - 1 counts, places lengths
from the longest to the shortest, each into the pack with most room left (the shortest pack), and keeps packs that look
alike as one pattern with a count. Where even the emptiest pack has no room, new packs open. Patterns are joined back to
pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rank_within
from .tokens import WordEncoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of each piece: the ids of the whole text and ``end_id``, cut at every ``capacity``.

    A null or empty text has the end id alone; rows with equal or null doc_id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end, step = WordEncoder.of(tokenizer), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows: list[tuple] = []
                part = batch.slice(at, 128)
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.encode_all(part["text"].to_pylist()), strict=True):
                    ids += end
                    rows += [(doc, i // 4, (len(b := ids[i : i + step])) // 4, len(ids) // 4, b) for i in range(0, len(ids), step)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ranks of a length lie at one offset of consecutive sequences.

    Each step takes a whole pattern or finishes a length, so the number of entries depends on the number of distinct lengths,
    not on the number of pieces.
    """
    out = []
    heap: list[tuple[int, int, int]] = []  # (-room, first sequence, count)
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                room, first, n = -heap[0][0], heap[0][1], heap[0][2]
                heapq.heappop(heap)
                take = min(n, left)
                out.append((length, rank, take, first, capacity - room))
                if n > take:
                    heapq.heappush(heap, (-room, first + take, n - take))
                if room > length:
                    heapq.heappush(heap, (length - room, first, take))
            else:
                take = -(-left // (capacity // length))  # the others of this length go on top of these
                out.append((length, rank, take, sequences, 0))
                if capacity > length:
                    heapq.heappush(heap, (length - capacity, sequences, take))
                sequences += take
            left, rank = left - take, rank + take
    return out


def padding(entries: list[tuple[int, int, int, int, int]], capacity: int) -> tuple[int, int]:
    """(ids, padded ids) of a plan, each sequence padded to the capacity unless its length is a power of two."""
    ids = sum(e[0] * e[2] for e in entries)
    ends: Counter = Counter()
    for length, _, n, first, offset in entries:
        for s in range(first, first + n):
            ends[s] = max(ends[s], offset + length)
    return ids, sum(0 if e & (e - 1) == 0 else capacity - e for e in ends.values())


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 4096) -> DataFrame:
    """Adds (sequence_id, offset) to pieces with a ``length`` of 1 to capacity; other columns stay.

    ``pieces`` must be a written table with (doc_id, start), which order pieces of a length where ids tie by hash. Pieces of
    one length may be a third of all rows: they are ranked in parts.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, rank, _, first, offset in entries:
        by_length.setdefault(length, []).append((rank, first, offset))
    # the arrays of a length: ranks at which its runs start, the sequence at rank 0 of the run, its offset
    rows = [(k, [r[0] for r in v], [r[1] for r in v], [r[2] for r in v]) for k, v in by_length.items()]
    plans = F.broadcast(spark.createDataFrame(rows, "length long, ranks array<long>, firsts array<long>, offsets array<long>"))
    ranked = rank_within(pieces, ["length"], ["doc_id", "start"])
    run = F.expr("aggregate(ranks, 0, (n, r) -> n + int(r <= rank))")
    found = ranked.join(plans, "length", "inner").withColumn("__run", run)
    return found.withColumn("sequence_id", F.expr("firsts[__run - 1] + rank - ranks[__run - 1]")).withColumn("offset", F.expr("offsets[__run - 1]")).select(*pieces.columns, "sequence_id", "offset")
