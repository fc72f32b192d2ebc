"""Token-id shards with a minimal perfect hash index.

A shard is a ``.bin`` file of raw little-endian ids, documents one after the other, unsigned and of 16 bits where the vocabulary
allows it, else of 32, and an ``.idx`` file:
the shard's keys in order, a minimal perfect hash over them, and for each of its slots a 32-bit fingerprint of the key, the
offset and the number of ids. A look-up hashes the key, reads one slot and compares the fingerprint: the time does not
depend on the size of the shard, and an absent key is refused but for one case in 2**32.

Shards are ranges of (doc_id, text hash) in ascending order, null doc_ids first. Files of a task attempt have a name of
their own; only those that a finished attempt reports are in the manifest, so a lost executor leaves no torn shard.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .files import open_fs
from .textscan import mix
from .tokens import WordEncoder

#: Slots per key that a level of the hash offers, and levels before the rest is kept as a sorted list.
_GAMMA, _LEVELS = 2.0, 48
MANIFEST = "shard int, file string, first_id long, last_id long, has_null boolean, n_docs long, n_tokens long"


def key_hash(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit hash of (doc_id or null, how many equal keys came before)."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x1234567))
    h = np.where(null, np.uint64(0x5BD1E995), h)
    return mix(h ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: a cascade of bit arrays, a key rests where it is alone."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = []
        n = 0
        for bits in levels:
            ones = np.cumsum(np.unpackbits(bits.view(np.uint8)).reshape(-1, 64).sum(1))
            self.before.append(n + np.r_[0, ones[:-1]])
            n += int(ones[-1])
        self.n = n + len(rest)

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * 0xA24BAED4963EE407 % (1 << 64))) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < _LEVELS:
            size = 64 * max(1, int(np.ceil(_GAMMA * len(keys) / 64)))
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone).view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, 0 to n - 1; any slot, or -1, for a key that was not in ``build``."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._at(keys[open_], level, 64 * len(bits)).astype(np.int64)
            byte = bits.view(np.uint8)
            hit = (byte[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            word, inside = at[hit] >> 6, at[hit] & 63
            eight = np.unpackbits(byte.reshape(-1, 8)[word], axis=1)
            out[open_[hit]] = self.before[level][word] + (eight * (np.arange(64) < inside[:, None])).sum(1)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[i] == keys[open_]
            out[open_[found]] = self.n - len(self.rest) + i[found]
        return out


def occurrence(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """For keys in order, how many equal ones came just before."""
    new = np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])] if len(ids) else np.zeros(0, bool)
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(ids) else at


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Keyed access to one shard."""

    def __init__(self, file: str):
        self.file = file
        fs, path = open_fs(file + ".idx")
        with fs.open_input_file(path) as f:
            a = np.load(io.BytesIO(f.read()), allow_pickle=False)
        self.ids, self.null, self.width = a["ids"], a["null"], int(a["width"])
        cuts = np.cumsum(a["sizes"])[:-1]
        self.hash = PerfectHash([np.ascontiguousarray(x) for x in np.split(a["bits"], cuts)] if len(a["sizes"]) else [], a["rest"])
        self.prints, self.offsets, self.lengths = a["prints"], a["offsets"], a["lengths"]

    def find(self, ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, number of ids) in ids; -1 where the shard has no such key."""
        keys = key_hash(ids, null, nth)
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == _fingerprint(keys[ok])
        return np.where(ok, self.offsets[slot] if self.hash.n else -1, -1), np.where(ok, self.lengths[slot] if self.hash.n else -1, -1)

    def payload(self) -> pa.NativeFile:
        fs, path = open_fs(self.file + ".bin")
        return fs.open_input_file(path)

    def read(self, payload: pa.NativeFile, offset: int, length: int) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        data = payload.read_at(self.width * int(length), self.width * int(offset))
        return np.frombuffer(data, "<u2").astype("<u4").tobytes() if self.width == 2 else data


def write_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of whole texts and ``end_id``, in ascending doc_id order; returns the manifest, a row a shard.

    A null or empty text has the end id alone. Equal doc_ids stay separate entries in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.of(tokenizer)
        width = 2 if len(encoder.last) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        file = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}"
        fs, path = open_fs(file + ".bin")
        fs.create_dir(os.path.dirname(path), recursive=True)
        ids: list[np.ndarray] = []
        null: list[np.ndarray] = []
        lengths: list[int] = []
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                key = batch["doc_id"]
                null.append(np.asarray(key.is_null()))
                ids.append(np.asarray(key.fill_null(0)))
                for at in range(0, batch.num_rows, 128):
                    found = encoder.encode_all(batch["text"].slice(at, 128).to_pylist())
                    lengths += [len(data) // 4 + 1 for data in found]
                    joined = end.join(found) + end
                    out.write(np.frombuffer(joined, "<u4").astype("<u2").tobytes() if width == 2 else joined)
        if not lengths:
            fs.delete_file(path)
            return
        i, n, size = np.concatenate(ids), np.concatenate(null), np.asarray(lengths, np.int64)
        keys = key_hash(i, n, occurrence(i, n))
        table = PerfectHash.build(keys)
        slot = table.slots(keys)
        prints, offsets, counts = np.empty(len(i), np.uint32), np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        prints[slot], offsets[slot], counts[slot] = _fingerprint(keys), np.cumsum(size) - size, size
        held = io.BytesIO()
        bits = np.concatenate(table.levels) if table.levels else np.zeros(0, np.uint64)
        np.savez(held, width=np.asarray(width), ids=i, null=n, sizes=np.asarray([len(x) for x in table.levels]), bits=bits, rest=table.rest, prints=prints, offsets=offsets, lengths=counts)
        with fs.open_output_stream(path[: -len(".bin")] + ".idx") as out:
            out.write(held.getvalue())
        valued = i[~n]
        first, last = (int(valued[0]), int(valued[-1])) if len(valued) else (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": part, "file": file, "first_id": first, "last_id": last, "has_null": bool(n.any()), "n_docs": len(i), "n_tokens": int(size.sum())}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.select("doc_id", "text").mapInArrow(run, MANIFEST)


def _starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids of all shards before; it has a row a shard, and the driver adds them up."""
    total, rows = 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r["shard"], r["file"], total))
        total += r["n_tokens"]
    spark = manifest.sparkSession
    return spark.createDataFrame(rows, "shard int, file string, base long").repartition(max(1, len(rows)), "shard")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; each key goes through its shard's perfect hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                nth = occurrence(shard.ids, shard.null)
                with shard.payload() as f:
                    for at in range(0, len(nth), 256):
                        s = slice(at, at + 256)
                        offset, length = shard.find(shard.ids[s], shard.null[s], nth[s])
                        if (length < 0).any():
                            raise ValueError(f"{row['file']}: a key of the shard is not in its index")
                        data = [shard.read(f, o, n) for o, n in zip(offset, length, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(shard.ids[s], pa.int64(), mask=shard.null[s]), pa.array(offset + row["base"]), pa.array(length), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return _starts(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fetch(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted ``doc_id`` of ``keys``; absent and null keys give no row, equal doc_ids a row each."""
    spark = keys.sparkSession
    ranges = manifest.select("shard", "file", "first_id", "last_id")
    wanted = keys.select(F.col("doc_id").cast("long")).distinct().join(F.broadcast(ranges), F.col("doc_id").between(F.col("first_id"), F.col("last_id"))) if _bounded(ranges) else keys.select(F.col("doc_id").cast("long")).distinct().join(ranges, F.col("doc_id").between(F.col("first_id"), F.col("last_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        for batch in batches:
            rows = []
            for file, doc in zip(batch["file"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                if file not in held:
                    held.clear()
                    held[file] = Shard(file)
                shard, nth = held[file], 0
                with shard.payload() as f:
                    while True:
                        offset, length = shard.find(np.asarray([doc]), np.asarray([False]), np.asarray([nth]))
                        if length[0] < 0:
                            break
                        rows.append({"doc_id": doc, "ids": shard.read(f, offset[0], length[0])})
                        nth += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    return wanted.repartition(partitions(spark), "doc_id").sortWithinPartitions("file").mapInArrow(run, "doc_id long, ids binary")


def _bounded(ranges: DataFrame, most: int = 100_000) -> bool:
    return ranges.limit(most + 1).count() <= most


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads them back: (doc_id, start, n_tokens, ids)."""
    scratch = Scratch(docs.sparkSession, "tokenfile")
    manifest = scratch.save(write_shards(docs, f"{scratch.root}/shards", tokenizer, end_id), "manifest")
    return read_shards(manifest)


