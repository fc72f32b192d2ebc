"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, from counts over all documents in ``BUCKETS`` hash buckets
(equal counts by hash; any total order is right), and a line's rarest words, its prefix, are posted: lines similar enough
share a word of their prefixes. Posted pairs pass the length filter, the positional filter (the words from the first shared one
on can make up the overlap; a pair is found at that word) and the parity of hashed words (each difference changes one bit), and
are verified on the full sets, read again from the texts.

Lines of one set are one class, whose first line stands for it, so repeated lines are never paired. A line needs one similar line
before it: a posting list gives each line one candidate, that of fewest differences, and says whether there may be more. Lines
whose candidate fails, and that may have more, are then compared with all earlier lines of their lists, and their next candidates
verified, a few first, until they go or have none left. Lists of more pairs than ``STAR`` lines have, or dealt out for their length, give a
candidate only from the list's first line and from neighbours of like size; their other pairs are left to that second pass. Only sizes
that the positional filter lets pass are paired. Pairs
are compared ``_PAIRS`` at a time, whatever the length of a list, and never become rows but for the nearest of each line.

Lines travel in blobs of numpy arrays, a row for each batch and bucket, and a task sees one bucket at a time: buckets follow the
number of lines, about ``_LINES`` or ``_POSTINGS`` each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hot_keys, partitions
from .neardup import _verified
from .textscan import Chunk, chunks, mix

#: Buckets of word counts, the least buckets of the filters that say which documents and lines are read again, and the longest
#: posting list whose pairs are all formed at once, if all its lines are of one size. Every line with a word takes part.
BUCKETS, FILTER, STAR, MIN_WORDS = 1 << 20, 1 << 21, 4096, 1
#: Lines and postings of a bucket, pairs that are compared at a time, and neighbours that a line of a long list is compared with.
_LINES, _POSTINGS, _PAIRS, _NEAR = 100_000, 400_000, 250_000, 8
#: Candidates of a line that the first round of the second pass verifies; each further round takes eight times as many.
_MOST = 8
#: Lines that are sorted at a time, and lines of a document that make a row.
_BLOCK, _PIECE = 4096, 1 << 20
_SLICES = 64
#: Filters have so many buckets for each of their rows, up to ``_FILTER_MOST`` (32 MB) in all, and travel in parts of ``_PART`` buckets.
_FILTER_EACH, _FILTER_MOST, _PART = 16, 1 << 28, 1 << 18
_LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rarity(docs: DataFrame) -> np.ndarray:
    """The level of each bucket, 0 to 63, rising with the number of its words in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for c in chunks(batch["text"], lower=True):
                total += np.bincount((c.hashes() >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        parts = np.split(total, _SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * _SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "lot", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
        return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, "slice int, lot int, counts binary").groupBy("slice", "lot").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind).collect()
    total = np.zeros(BUCKETS, np.int64)
    for r in rows:
        total.reshape(_SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(63, 2 * np.log2(total + 1.0)).astype(np.uint8)


def word_ranks(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """52 bits of each word: the level of its bucket, then its hash; a prefix word is posted under the lower 32."""
    return (level[(h >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(46)) | (h >> np.uint64(18))


def line_sets(c: Chunk, level: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with enough different words: document, number in it, and size; then all words' ranks, rarest first, line by line, and their starts."""
    ldoc, ls, _ = c.lines()
    number = np.arange(len(ldoc)) - np.searchsorted(ldoc, np.arange(c.n))[ldoc]
    first = np.r_[np.searchsorted(c.start, ls), len(c.start)]
    words = np.diff(first)
    rank = word_ranks(c.hashes(), level)
    ranks, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, len(ls), _BLOCK):  # one sort by line and rank: twelve bits of line above the rank's 52
        b = min(len(ls), a + _BLOCK)
        x = rank[first[a] : first[b]] | (np.repeat(np.arange(b - a, dtype=np.uint64), words[a:b]) << np.uint64(52))
        x.sort()
        x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
        size = np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=b - a)
        if least_words > 1:
            x = x[np.repeat(size >= least_words, size)]
        ranks.append(x & np.uint64((1 << 52) - 1))
        sizes.append(size)
    size = np.concatenate(sizes)
    ok = size >= max(1, least_words)
    size = size[ok]
    return ldoc[ok], number[ok], size, np.concatenate(ranks), np.cumsum(size) - size


def set_hash(rank: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = rank * _ODD
    x ^= x >> np.uint64(32)
    return mix(np.add.reduceat(x, start) + size.astype(np.uint64)).view(np.int64) if len(start) else np.zeros(0, np.int64)


def parities(rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line, flipped by each word."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bit = np.uint64(1) << (rank & np.uint64(63))
    high = np.where(rank & np.uint64(64), bit, np.uint64(0))
    return np.bitwise_xor.reduceat(bit ^ high, start).view(np.int64), np.bitwise_xor.reduceat(high, start).view(np.int64)


def _blobs(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values between bounds as binary rows."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a blob column."""
    if not len(column):
        return np.zeros(0, kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start to start + count of each, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _prefix(size: np.ndarray, tenths: int) -> np.ndarray:
    """Words of a prefix; none where neither one word more nor another word leaves a line similar: it is only like its class."""
    return np.where(10 * size >= tenths * (size + 1), size - -(-tenths * size // 10) + 1, 0)


KINDS = {"line": np.int32, "fp": np.int64, "n": np.int32, "parity": np.int64, "parity2": np.int64}


def _lines(docs: DataFrame, held, least_words: int, tenths: int) -> DataFrame:
    """A row for each document with lines (and for each ``_PIECE`` of its lines): d, rk, piece, lines, and blobs of what ``KINDS`` names and of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch["text"], lower=True):
                doc, number, size, rank, start = line_sets(c, held.value, least_words)
                prefix = _prefix(size, tenths)
                keys = rank[_ragged(start, prefix)].astype(np.uint32).view(np.int32)
                piece = number // _PIECE
                head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])]) if len(doc) else doc
                bounds = np.r_[head, len(doc)]
                own = pa.array(c.first + doc[head])
                one, two = parities(rank, start)
                values = {"line": number.astype(np.int32), "fp": set_hash(rank, start, size), "n": size.astype(np.int32), "parity": one, "parity2": two}
                yield pa.RecordBatch.from_arrays([batch["d"].take(own), batch["rk"].take(own), pa.array(piece[head].astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), *(_blobs(bounds, values[k]) for k in KINDS), _blobs(np.r_[0, np.cumsum(prefix)][bounds], keys)], ["d", "rk", "piece", "lines", *KINDS, "keys"])

    return docs.select("d", "rk", "text").mapInArrow(run, f"d long, rk long, piece int, lines int, {', '.join(f'{k} binary' for k in KINDS)}, keys binary")


def _numbered(n_buckets: int, tenths: int):
    """Lines in order get ascending ids and go to the bucket of their set's hash; rows that repeat a document's key are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            rk, piece = np.asarray(batch["rk"]), np.asarray(batch["piece"])
            if not len(rk):
                continue
            new = np.r_[(rk[0], piece[0]) != last, (rk[1:] != rk[:-1]) | (piece[1:] != piece[:-1])]
            last = (rk[-1], piece[-1])
            batch = batch.filter(pa.array(new))
            values = {k: _flat(batch[k], kind) for k, kind in KINDS.items()}
            values["rk"] = np.repeat(rk[new], np.asarray(batch["lines"]))
            values["id"] = at + np.arange(len(values["fp"]))
            at += len(values["fp"])
            keys, prefix = _flat(batch["keys"], np.int32), _prefix(values["n"].astype(np.int64), tenths)
            bucket = (values["fp"].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            bounds, ends = np.r_[head, len(bucket)], np.cumsum(prefix)
            rows = _ragged((ends - prefix)[order], prefix[order])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), *(_blobs(bounds, values[k][order]) for k in LINE), _blobs(np.r_[0, np.cumsum(prefix[order])][bounds], keys[rows])], ["bucket", *LINE, "keys"])

    return run


LINE = {"id": np.int64, "rk": np.int64, **KINDS}
CLASSES = "id long, rk long, line int, fp long, n int, parity long, parity2 long, keys binary"


def _buckets(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """The blobs of the one bucket that a task has, together."""
    held = [[_flat(batch[k], kind) for k, kind in kinds.items()] for batch in batches]
    if held and sum(len(x[0]) for x in held):
        yield {k: np.concatenate(x) for k, x in zip(kinds, zip(*held, strict=True), strict=True)}


def _classes(tenths: int):
    """The first line of each set, and (rk, line) alone of the others, which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _buckets(batches, LINE | {"keys": np.int32}):
            order = np.lexsort((v["id"], v["fp"]))
            fp = v["fp"][order]
            new = np.r_[True, fp[1:] != fp[:-1]]
            first, rest = np.sort(order[new]), order[~new]
            prefix = _prefix(v["n"].astype(np.int64), tenths)
            rows = _ragged((np.cumsum(prefix) - prefix)[first], prefix[first])
            yield pa.RecordBatch.from_arrays([*(pa.array(v[k][first]) for k in LINE), _blobs(np.r_[0, np.cumsum(prefix[first])], v["keys"][rows])], [*LINE, "keys"])
            if len(rest):
                none = [pa.nulls(len(rest), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(v["rk"][rest]), pa.array(v["line"][rest]), *none[1:]], [*LINE, "keys"])

    return run


POSTING = {"key": np.int32, "part": np.int32, "id": np.int64, "packed": np.int64, "parity": np.int64, "parity2": np.int64}
#: Of probes: the (differences, id) of the candidate that they were last compared with.
PROBE = {"differ": np.int32, "after": np.int64}


def _posted(hot: list[tuple], n_buckets: int, role: int = 3, asked=None):
    """Postings of classes by bucket of (key, part); lines under a hot key are dealt over its parts.

    ``role``: 1 for lines that others are compared with, 2 for those that are compared, 3 for both. With ``asked``, a filter of keys,
    only such keys are posted. Probes (role 2) go to every part of a hot key.
    """
    hot = sorted(hot)
    hot_key, hot_parts = np.array([k for k, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, n = np.asarray(batch["id"]), np.asarray(batch["n"]).astype(np.int64)
            key = _flat(batch["keys"], np.int32)
            count = np.diff(np.frombuffer(batch["keys"].buffers()[1], np.int32)[batch["keys"].offset :][: len(n) + 1]) // 4 if len(n) else n
            row = np.repeat(np.arange(len(n)), count)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            if asked:
                ok = _within(asked.value, key.astype(np.int64))
                key, row, pos = key[ok], row[ok], pos[ok]
            part = np.full(len(key), -1, np.int64)
            if len(hot):
                i = np.minimum(np.searchsorted(hot_key, key), len(hot) - 1)
                parts = np.where(hot_key[i] == key, hot_parts[i], 0)
                if role == 2:
                    each = np.repeat(np.arange(len(key)), np.maximum(parts, 1))
                    part = np.where(parts[each] > 0, _ragged(np.zeros(len(key), np.int64), np.maximum(parts, 1)), -1)
                    key, row, pos = key[each], row[each], pos[each]
                else:
                    own = (mix(ident[row].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
                    part = np.where(parts > 0, own, -1)
            bucket = (mix(key.astype(np.int64).view(np.uint64) + part.view(np.uint64) * _ODD) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row = bucket[order], row[order]
            head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            bounds = np.r_[head, len(bucket)]
            values = {"key": key[order], "part": part[order].astype(np.int32), "id": ident[row], "packed": (n[row] << 32) | (pos[order] << 2) | role, "parity": np.asarray(batch["parity"])[row], "parity2": np.asarray(batch["parity2"])[row]}
            if asked:
                values |= {k: np.asarray(batch[k])[row].astype(kind) if role == 2 else np.zeros(len(row), kind) for k, kind in PROBE.items()}
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), *(_blobs(bounds, x) for x in values.values())], ["bucket", *values])

    return run


class _Lists:
    """The posting lists of a bucket: postings sorted by key, part, size and id."""

    def __init__(self, v: dict[str, np.ndarray], tenths: int):
        n = v["packed"] >> 32
        order = np.lexsort((v["id"], n, v["part"], v["key"]))
        self.tenths, self.n, self.id = tenths, n[order], v["id"][order]
        self.key, self.part = v["key"][order], v["part"][order]
        packed = v["packed"][order]
        self.pos, self.role = (packed >> 2) & ((1 << 30) - 1), packed & 3
        self.parity = [v["parity"][order], v["parity2"][order]]
        self.probe = {k: v[k][order] for k in PROBE if k in v}
        self.start = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])])
        self.length = np.diff(np.r_[self.start, len(self.key)])
        self.list = np.repeat(np.arange(len(self.start)), self.length)

    def reach(self, least: np.ndarray, side: str) -> np.ndarray:
        """Of each posting, where sizes of ``least`` begin (left) or end (right) in its list."""
        most = int(self.n.max()) + 1
        at = self.list * (most + 1) + self.n
        return np.searchsorted(at, self.list * (most + 1) + np.clip(least, 0, most), side)

    def largest(self) -> np.ndarray:
        """The size up to which lines may be similar to a posting's line, by length and by the words that it has from there on."""
        t, n = self.tenths, self.n
        return np.minimum(10 * n // t, (10 + t) * (n - self.pos) // t - n)

    def passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(earlier, later, differing parity bits) of the pairs that pass the length, positional and parity filters."""
        t, n = self.tenths, self.n
        need = -(-t * (n[i] + n[j]) // (10 + t))
        ok = (10 * np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j])) & (np.minimum(n[i] - self.pos[i], n[j] - self.pos[j]) >= need) & (self.id[i] != self.id[j])
        i, j, need = i[ok], j[ok], need[ok]
        differ = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in self.parity)
        ok = differ <= n[i] + n[j] - 2 * need
        i, j = i[ok], j[ok]
        earlier = self.id[i] < self.id[j]
        return np.where(earlier, i, j), np.where(earlier, j, i), differ[ok]

    def pairs(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each posting ``at`` with those from low to high, ``_PAIRS`` at a time."""
        count = np.maximum(high - low, 0)
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        while len(at):
            ends = np.cumsum(count)
            k = int(np.searchsorted(ends, _PAIRS, "right"))
            if k == 0:  # one posting has more
                yield np.full(_PAIRS, at[0]), low[0] + np.arange(_PAIRS)
                low[0] += _PAIRS
                count[0] -= _PAIRS
                continue
            yield np.repeat(at[:k], count[:k]), _ragged(low[:k], count[:k])
            at, low, count = at[k:], low[k:], count[k:]


def _candidates(tenths: int):
    """(b, a, differ, more): a line's best earlier candidate in a bucket, and whether there may be others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _buckets(batches, POSTING):
            x = _Lists(v, tenths)
            rows = np.arange(len(x.id))
            # the smaller line of a pair leads, and shares a word among its rarest ones
            leads = x.n - x.pos >= -(-2 * tenths * x.n // (10 + tenths))
            high = x.reach(x.largest(), "right")
            pairs = np.bincount(x.list, np.where(leads, high - rows - 1, 0))
            long = ((pairs > STAR * STAR / 2) | (x.part[x.start] >= 0))[x.list]
            high = np.where(long, np.minimum(high, rows + 1 + _NEAR), high)
            at = rows[leads]
            best, many = np.full(len(x.id), _LAST), np.zeros(len(x.id), bool)

            def offer(i: np.ndarray, j: np.ndarray) -> None:
                a, b, differ = x.passing(i, j)
                seen = best[b] < _LAST
                np.minimum.at(best, b, (differ << 40) | a)
                many[b[seen]] = True
                order = np.sort(b)
                many[order[1:][order[1:] == order[:-1]]] = True

            for i, j in x.pairs(at, at + 1, high[leads]):
                offer(i, j)
            if long.any():
                first = np.lexsort((x.id, x.list))[x.start]
                j = rows[long]
                offer(first[x.list[j]], j)
            many |= long
            b = np.flatnonzero((best < _LAST) | many)
            a = best[b]
            none = a == _LAST
            yield pa.RecordBatch.from_arrays([pa.array(x.id[b]), pa.array(x.id[np.where(none, 0, a & ((1 << 40) - 1))], mask=none), pa.array(np.where(none, 0, a >> 40), mask=none), pa.array(many[b])], ["b", "a", "differ", "more"])

    return run


def _next_candidates(tenths: int, most: int):
    """(b, a, differ): of each probe and list, the next ``most`` earlier candidates after its last, by (differ, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _buckets(batches, POSTING | PROBE):
            x = _Lists(v, tenths)
            low, high = x.reach(-(-tenths * x.n // 10), "left"), x.reach(x.largest(), "right")
            at = np.flatnonzero(x.role == 2)
            held = [np.zeros(0, np.int64)] * 3

            def rows(keep: np.ndarray) -> pa.RecordBatch:
                a, b, differ = (y[keep] for y in held)  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(x.id[b]), pa.array(x.id[a]), pa.array(differ)], ["b", "a", "differ"])  # noqa: B023

            for i, j in x.pairs(at, low[at], high[at]):
                ok = (x.id[j] < x.id[i]) & (x.role[j] == 1)
                a, b, differ = x.passing(i[ok], j[ok])
                last = x.probe["differ"][b]
                new = (differ > last) | ((differ == last) & (x.id[a] > x.probe["after"][b]))
                a, b, differ = (np.r_[y, z[new]] for y, z in zip(held, (a, b, differ), strict=True))
                order = np.lexsort((x.id[a], differ, b))
                a, b, differ = a[order], b[order], differ[order]
                rank = np.arange(len(b)) - np.searchsorted(b, b)
                held = [y[rank < most] for y in (a, b, differ)]
                open_ = held[1] == i[-1]  # pairs come probe by probe
                if not open_.all():
                    yield rows(~open_)
                    held = [y[open_] for y in held]
            if len(held[0]):
                yield rows(np.ones(len(held[0]), bool))

    return run


def _bits(df: DataFrame, column: str) -> np.ndarray:
    """Which buckets of a whole number are in use, eight a byte. There are more buckets than rows, so that few others are let in."""
    size = FILTER
    while size < min(_FILTER_MOST, _FILTER_EACH * df.count()):
        size *= 2
    part = min(_PART, size)

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(part, bool)
        bits[table["b"].to_numpy() % part] = True
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    used = df.select(F.pmod(F.col(column).cast("long"), F.lit(size)).alias("b")).distinct().select(F.expr(f"int(b div {part})").alias("part"), "b")
    out = np.zeros(size // 8, np.uint8)
    for r in used.groupBy("part").applyInArrow(pack, "part int, bits binary").collect():
        out.reshape(-1, part // 8)[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _within(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each whole number is let in by a filter of ``_bits``."""
    at = x % (8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _sets(docs: DataFrame, wanted: DataFrame, held, least_words: int) -> DataFrame:
    """(fp, items): the ranks of the words of wanted classes (id, rk, hash), from their first lines' documents; fp is the id."""
    spark = docs.sparkSession
    by_doc, by_line = (spark.sparkContext.broadcast(_bits(wanted, c)) for c in ("rk", "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_within(by_doc.value, np.asarray(batch["rk"]))))
            for c in chunks(batch["text"], lower=True):
                _, _, size, rank, start = line_sets(c, held.value, least_words)
                fp = set_hash(rank, start, size)
                at = np.flatnonzero(_within(by_line.value, fp))
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), _blobs(np.r_[0, np.cumsum(size[at])], rank[_ragged(start[at], size[at])])], ["hash", "items"])

    sets = docs.select("rk", "text").mapInArrow(run, "hash long, items binary")
    return wanted.select(F.col("id").alias("fp"), "hash").join(sets.dropDuplicates(["hash"]), "hash").select("fp", "items")


def duplicate_lines(keyed: DataFrame, scratch: Scratch, least_words: int = MIN_WORDS, tenths: int = 8) -> DataFrame:
    """(rk, removed): the numbers of the lines that go, for documents (d, rk, text) that lose any."""
    spark, n = keyed.sparkSession, partitions(keyed.sparkSession)
    held = spark.sparkContext.broadcast(rarity(keyed))
    lines = scratch.save(_lines(keyed, held, least_words, tenths), "lines")
    n_lines = max(n, -(-(lines.agg(F.sum("lines")).first()[0] or 0) // _LINES))
    ordered = lines.repartitionByRange(n, "d", "rk", "piece").sortWithinPartitions("d", "rk", "piece")
    blobs = ", ".join(f"{k} binary" for k in LINE)
    dealt = ordered.mapInArrow(_numbered(n_lines, tenths), f"bucket int, {blobs}, keys binary").repartitionById(n_lines, "bucket")
    known = scratch.save(dealt.mapInArrow(_classes(tenths), CLASSES), "classes")
    scratch.forget(lines)
    classes = known.where("id is not null")
    posts = F.when(10 * F.col("n") >= tenths * (F.col("n") + 1), F.col("n") - F.ceil(F.lit(tenths) * F.col("n") / 10) + 1).otherwise(0)
    n_posts = max(n, -(-(classes.agg(F.sum(posts)).first()[0] or 0) // _POSTINGS))

    def keys_of(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_flat(batch["keys"], np.int32))], ["key"])

        return df.select("keys").mapInArrow(run, "key int")

    def by_bucket(posted: list[tuple], kinds: dict[str, type], work: Callable, kind: str) -> DataFrame:
        blobs = None
        for df, how in posted:
            own = df.mapInArrow(how, f"bucket int, {', '.join(f'{k} binary' for k in kinds)}")
            blobs = own if blobs is None else blobs.union(own)
        return blobs.repartitionById(n_posts, "bucket").mapInArrow(work, kind)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = scratch.save(pairs.selectExpr("explode(array(a, b)) id").distinct().join(classes.selectExpr("id", "rk", "fp hash"), "id"), "wanted")
        sets = scratch.save(_sets(keyed, wanted, held, least_words), "sets")
        return scratch.save(_verified(pairs, sets, tenths / 10).select(F.col("v").alias("id")).distinct(), "resolved")

    # the keys of a sixteenth of the lines plan the dealing; they decide no pair
    hot = hot_keys(keys_of(classes.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0)), ["key"], least=STAR // 16)
    posting = classes.select("id", "n", "parity", "parity2", "keys")
    found = by_bucket([(posting, _posted(hot, n_posts))], POSTING, _candidates(tenths), "b long, a long, differ long, more boolean")
    first = scratch.save(found.groupBy("b").agg(F.min_by("a", "differ").alias("a"), (F.max("more") | F.coalesce(F.min("a") < F.max("a"), F.lit(False))).alias("more")), "first")
    resolved = verified(first.where("a is not null").select("a", "b"))
    left = first.where("more").join(resolved.selectExpr("id b"), "b", "left_anti").selectExpr("b id", "-1 differ", "0L after")
    most = _MOST
    while (left := scratch.save(left, "left")).take(1):
        # a round compares each line with its next candidates, more of them each time, until it goes or has none left
        probes = scratch.save(posting.join(left, "id"), "probes")
        asked = spark.sparkContext.broadcast(_bits(keys_of(probes), "key"))
        both = [(posting, _posted(hot, n_posts, 1, asked)), (probes, _posted(hot, n_posts, 2, asked))]
        found = by_bucket(both, POSTING | PROBE, _next_candidates(tenths, most), "b long, a long, differ long")
        nearest = F.slice(F.sort_array(F.collect_set(F.struct(F.col("differ").cast("int").alias("differ"), "a"))), 1, most)
        tried = scratch.save(found.groupBy("b").agg(nearest.alias("next")), "tried")
        done = verified(tried.selectExpr("b", "explode(next) x").select("x.a", "b"))
        resolved = resolved.union(done)
        left = tried.where(F.size("next") == most).selectExpr("b id", "element_at(next, -1) x").join(done, "id", "left_anti").selectExpr("id", "x.differ", "x.a after")
        most *= 8
    gone = classes.select("id", "rk", "line").join(resolved, "id", "left_semi").select("rk", "line").union(known.where("id is null").select("rk", "line"))
    return scratch.save(gone.groupBy("rk").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")


def dedup_lines(docs: DataFrame, least: float = 0.8, least_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text less the lines that are similar to a line before, n_lines and removed (their numbers from 0).

    Lines come in the order of doc_id, null last, and their place in the text. A line goes if an earlier one, removed or not,
    has a Jaccard similarity of ``least`` (in tenths) or more on its words, lower-cased in A-Z; lines without a word, or
    of fewer than ``least_words`` different ones, stay. Null texts stay null with one line. Rows that repeat doc_id and text count as one document.
    Columns n_lines and removed of ``docs`` itself give way to those.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "linededup")
    docs = docs.drop("n_lines", "removed")
    rk = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("d"), rk.alias("rk"), "text")
    removed = duplicate_lines(keyed, scratch, least_words, round(10 * least))
    held = spark.sparkContext.broadcast(_bits(removed, "rk"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def counted(batch: pa.RecordBatch, text: pa.Array, gone: pa.Array) -> pa.RecordBatch:
        lines = pc.add(pc.fill_null(pc.count_substring(batch["text"], "\n"), 0).cast(pa.int64()), 1)
        return pa.RecordBatch.from_arrays([*(text if n == "text" else batch[n] for n in names), lines, gone], [*names, "n_lines", "removed"])

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_within(held.value, np.asarray(batch["__rk"])) == wanted))
                yield batch if wanted else counted(batch, batch["text"], pa.nulls(batch.num_rows, pa.list_(pa.int32())))

        return run

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch["text"], batch["__removed"]
            if gone.null_count < len(gone):
                texts = text.to_pylist()
                for i in np.flatnonzero(np.asarray(gone.is_valid())).tolist():
                    g = set(gone[i].as_py())
                    texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in g])
                text = pa.array(texts, pa.string())
            yield counted(batch, text, gone)

    # only documents that lose lines, and a few whose bits clash with theirs, are shuffled
    whole = docs.withColumn("__rk", rk)
    same = whole.mapInArrow(part(False), schema)
    hit = whole.mapInArrow(part(True), whole.schema).join(removed.selectExpr("rk __rk", "removed __removed"), "__rk", "left").select(*names, "__removed")
    return same.union(hit.mapInArrow(rebuild, schema))
