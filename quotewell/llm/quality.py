"""Quality rules on repetition, measured in characters that lie inside duplicated n-grams and lines.

All n-grams of several lengths are hashed by prefix sums over the words' hashes; a word of an n-gram that stood earlier in the
text is covered, and a rule compares the characters of covered words with those of all words. With ``first_too``, as in op4_quality,
the first copy's words are covered as well: passages that occur twice then count in full, which later copies alone only do to a
half, where the base rule rejects already. The verdict is of the base rule and of repetition alone; ``symbol_limit`` adds, where it
is given, a plain rule on the share of words with a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textscan import Chunk, chunks, mix, rolling, span_hash

#: The largest share of characters in repeated n-grams of so many words, and in repeated lines.
NGRAM_LIMITS = {5: 0.25, 7: 0.24, 10: 0.23}
LINE_LIMIT = 0.30
#: Symbols that base counts.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, and whether the key stood at an earlier one."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    where = np.flatnonzero(twice[at] == key)
    _, first = np.unique(key[where], return_index=True)
    later = np.ones(len(where), bool)
    later[first] = False
    return where, later


def _covered(start: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that lie in a window of n words from one of the starts."""
    edge = np.zeros(words + n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge)[:words] > 0


def measure(c: Chunk, ngrams: tuple[int, ...], first_too: bool = False) -> dict[str, np.ndarray]:
    h, doc, n = c.hashes(), c.doc, c.n
    chars = np.r_[0, np.cumsum((c.buf & 0xC0) != 0x80)]
    size = chars[c.end] - chars[c.start]
    salt = mix(doc.astype(np.uint64))
    total = lambda mask, of: np.bincount(doc[mask], weights=of[mask], minlength=n).astype(np.int64)
    out = {"n_words": c.counts(), "word_chars": np.bincount(doc, weights=size, minlength=n).astype(np.int64)}
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    symbols = np.r_[0, np.cumsum(table[c.buf])]
    out["n_symbols"] = symbols[c.bounds[1:]] - symbols[c.bounds[:-1]]
    has = (symbols[c.end] - symbols[c.start]) > 0
    out["symbol_words"] = np.bincount(doc[has], minlength=n)
    grams = []
    for k in (3, *ngrams):
        key = rolling(h, k)
        inside = doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        where, later = _later(key[at] ^ salt[at])
        if k == 3:
            cover = _covered(at[where], k, len(h))
            out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
        else:
            grams.append(total(_covered(at[where if first_too else where[later]], k, len(h)), size))
    out["dup_ngram_chars"] = np.stack(grams, 1) if grams else np.zeros((n, 0), np.int64)
    ldoc, ls, le = c.lines()
    wordy = np.searchsorted(c.start, le) > np.searchsorted(c.start, ls)
    ldoc, ls, le = ldoc[wordy], ls[wordy], le[wordy]
    where, later = _later(span_hash(c.buf, ls, le) ^ mix(ldoc.astype(np.uint64)))
    dup = where[later]
    out["n_dup_lines"] = np.bincount(ldoc[dup], minlength=n)
    words = np.r_[0, np.cumsum(size)]
    in_line = words[np.searchsorted(c.start, le[dup])] - words[np.searchsorted(c.start, ls[dup])]
    out["dup_line_chars"] = np.bincount(ldoc[dup], weights=in_line, minlength=n).astype(np.int64)
    return out


def repetition(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float | None = None, first_too: bool = False) -> DataFrame:
    """A row a document with its measures and the verdict ``kept``; ``first_too`` counts the first copies of n-grams with the later.

    Null and empty texts have no words and fail the base rule; rows with equal or null doc_id are judged each by itself.
    """
    small_batches(docs.sparkSession)
    limits = dict(sorted((NGRAM_LIMITS if ngram_limits is None else ngram_limits).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch["text"]):
                m = measure(c, tuple(limits), first_too)
                base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                bad = base | (m["dup_line_chars"] > line_limit * m["word_chars"])
                if symbol_limit is not None:
                    bad |= m["symbol_words"] > symbol_limit * m["n_words"]
                for i, limit in enumerate(limits.values()):
                    bad |= m["dup_ngram_chars"][:, i] > limit * m["word_chars"]
                grams = pa.ListArray.from_arrays(np.arange(c.n + 1, dtype=np.int32) * len(limits), m["dup_ngram_chars"].ravel())
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
                cols = [batch["doc_id"].slice(c.first, c.n), *(pa.array(m[k], pa.int64()) for k in names), grams, pa.array(base), pa.array(~bad)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "dup_ngram_chars", "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)
