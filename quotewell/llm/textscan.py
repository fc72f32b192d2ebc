"""Byte-level scanning of Arrow text columns in numpy: words, lines and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For terms: all of ASCII but letters parts them.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at a time, and bytes of whole documents that make a chunk.
_SLICE, _CHUNK = 1 << 18, 1 << 20
#: The first k of eight bytes, read as a little-endian number.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap.

    Spans of up to 48 bytes are hashed in words of eight bytes, longer ones by prefix sums of their bytes.
    """
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), np.uint64, buffer=padded, strides=(1,))
    out = mix((eight[starts] & _KEPT[np.minimum(size, 8)]) + size.astype(np.uint64) * _P)
    at = np.flatnonzero(size > 8)
    for done in range(8, 48, 8):
        if not len(at):
            return out
        out[at] = mix((out[at] ^ (eight[starts[at] + done] & _KEPT[np.minimum(size[at] - done, 8)])) * _P)
        at = at[size[at] > done + 8]
    if len(at):
        out[at] = byte_hash(buf, starts[at], ends[at])
    return out


def byte_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same by prefix sums of bytes: slower, and not dependent on how long a span is."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        last = int(ends[j - 1])
        power, inverse = _power(max(last - base, _SLICE) + 1)
        total = np.zeros(last - base + 1, np.uint64)
        np.cumsum(_BYTE[buf[base:last]] * power[: last - base], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes, by prefix sums; n-grams that cross documents are the caller's to drop."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1] + np.uint64(n))


@dataclass
class Chunk:
    """Whole documents of one batch: rows first to first + n; word k lies in document doc[k] (from 0) at bytes start[k] to end[k]."""

    first: int
    n: int
    buf: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    _raw: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hash(self.buf, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of each line, split at \\n."""
        cut = np.flatnonzero(self._raw == 10)
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.bounds[1:], cut, "right")])
        ends = np.concatenate([self.bounds[1:], cut])
        order = np.lexsort((ends, doc))
        doc, ends = doc[order], ends[order]
        starts = np.r_[0, ends[:-1] + 1]
        new = np.r_[True, doc[1:] != doc[:-1]]
        starts[new] = self.bounds[:-1][doc[new]]
        return doc, starts, ends


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "").cast(pa.large_string())
    if text.offset or len(text) == 0:
        text = pa.concat_arrays([text]) if len(text) else pa.array([], pa.large_string())
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(text: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Iterator[Chunk]:
    """Words of a text column, a few MB of whole documents at a time; ``space`` says which bytes part words."""
    buf, offs = text_buffers(text)
    i, rows = 0, len(offs) - 1
    while i < rows:
        j = min(rows, max(i + 1, int(np.searchsorted(offs, offs[i] + _CHUNK, "right")) - 1))
        raw = buf[offs[i] : offs[j]]
        bounds = offs[i : j + 1] - offs[i]
        word = (raw != 32) & (raw - np.uint8(9) > 4) if space is SPACE else ~space[raw]
        before = np.empty_like(word)
        after = np.empty_like(word)
        if len(word):
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            before[bounds[:-1][bounds[:-1] < len(word)]] = False
            after[bounds[1:][bounds[1:] > 0] - 1] = False
        start = np.flatnonzero(word & ~before)
        end = np.flatnonzero(word & ~after) + 1
        first = np.searchsorted(start, bounds)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        yield Chunk(i, j - i, raw | ((raw - np.uint8(65) < 26).view(np.uint8) << 5) if lower else raw, bounds, doc, start, end, raw)
        i = j
