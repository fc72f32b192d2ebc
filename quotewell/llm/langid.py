"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of training are summed by Spark; the matrix of log probabilities (languages x buckets) is broadcast, and
batches are scored as sparse counts in numpy, a few languages at a time, however many were learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Buckets of hashed n-grams, lengths of n-grams, labelled rows that are learned from (about; by the hash of doc_id), and
#: languages that are scored at a time. The matrix takes 256 KB a language.
BUCKETS, LENGTHS, MAX_TRAIN, LANG_BLOCK = 1 << 16, (1, 2, 3), 20_000, 16
#: n-grams' worth of evidence at most in a score: neighbours depend on each other.
EVIDENCE = 60
_CHARS = 1 << 18
_table: list[np.ndarray] = []


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id is neither held out nor learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def letters() -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _table[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the n-grams of whole texts, and the number of letters of each text."""
    low = [(t or "").lower() for t in texts]
    lens = np.array([len(t) + 1 for t in low])
    code = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    doc = np.repeat(np.arange(len(low), dtype=np.uint32), lens)
    letter = letters()[code]
    code[~letter] = 32
    n_letters = np.bincount(doc[letter], minlength=len(low))
    # runs of other characters count as one
    keep = letter | np.r_[False, letter[:-1]] if len(letter) else letter
    code, doc = code[keep].astype(np.uint64), doc[keep]
    keys = []
    for n in LENGTHS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) + code[k : len(code) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = doc[: len(h)] == doc[n - 1 :]
        if n == 1:
            inside &= code != 32
        keys.append((doc[: len(h)][inside] * np.uint32(BUCKETS)) + (h[inside] >> np.uint64(48)).astype(np.uint32))
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return key // BUCKETS, key % BUCKETS, count, n_letters


def _parts(texts: list) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch by characters, fewer than 2**16 documents each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held > _CHARS or i - at >= 60_000:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray
    #: Mean log probability of an n-gram, by language, halfway between the training sample's and an n-gram's never seen.
    least_fit: np.ndarray | float = -np.inf


def train(docs: DataFrame, most: int = MAX_TRAIN, smoothing: float = 0.5) -> Model:
    """Learns from text and non-null lang of about ``most`` rows that aren't held out, chosen by the hash of doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = rows.count()
    if n > most:
        rows = rows.where(F.xxhash64(F.col("doc_id"), F.lit(7)) / F.lit(2.0**64) + 0.5 < most / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for at, part in _parts(batch["text"].to_pylist()):
                doc, bucket, count, _ = grams(part)
                own = langs[at : at + len(part)]
                for lang in set(own):
                    mask = (own == lang)[doc]
                    total[lang] = total.get(lang, 0) + np.bincount(bucket[mask], weights=count[mask], minlength=BUCKETS)
                    seen[lang] = seen.get(lang, 0) + int((own == lang).sum())
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[seen[lang], counts[at]].astype(float))], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    # the training sample bounds these rows; the matrix is filled a language at a time
    where = np.searchsorted(np.array(langs, object), np.array(counted["lang"].to_pylist(), object)) if langs else np.zeros(0, int)
    order = np.argsort(where, kind="stable")
    bucket, n, cuts = counted["bucket"].to_numpy()[order], counted["n"].to_numpy()[order], np.searchsorted(where[order], np.arange(len(langs) + 1))
    log_prob, prior, least_fit = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)), np.zeros(len(langs))
    for k in range(len(langs)):
        own = slice(cuts[k], cuts[k + 1])
        doc = bucket[own] < 0
        prior[k] = n[own][doc].sum()
        counts = np.zeros(BUCKETS)
        counts[bucket[own][~doc]] = n[own][~doc]
        logs = np.log((counts + smoothing) / (counts + smoothing).sum())
        log_prob[:, k] = logs
        least_fit[k] = ((counts * logs).sum() / max(counts.sum(), 1) + np.log(smoothing / (counts + smoothing).sum())) / 2
    return Model(langs, log_prob, np.log(prior / prior.sum()) if langs else prior, least_fit)


def score_texts(model: Model, texts: list) -> tuple[list[str], np.ndarray]:
    return _scored(model, texts)[:2]


def _scored(model: Model, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and whether the text is more like the language's training sample than like n-grams never seen."""
    doc, bucket, count, n_letters = grams(texts)
    out = np.zeros((len(texts), len(model.langs)))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    for at in range(0, len(model.langs) if len(starts) else 0, LANG_BLOCK):
        each = model.log_prob[bucket, at : at + LANG_BLOCK] * count[:, None]
        out[doc[starts], at : at + LANG_BLOCK] = np.add.reduceat(each.astype(np.float64), starts, axis=0)
    total = np.bincount(doc, weights=count, minlength=len(texts))
    mean = out / np.maximum(total, 1)[:, None]
    out = out * (np.minimum(total, EVIDENCE) / np.maximum(total, 1))[:, None] + model.prior
    p = np.exp(out - out.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    none = n_letters == 0
    row = np.arange(len(best))
    return ["und" if none[i] else model.langs[b] for i, b in enumerate(best)], np.where(none, 0.0, p[row, best]), ~none & (mean[row, best] >= np.broadcast_to(model.least_fit, len(model.langs))[best])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and fits of every whole text; texts that are null or have no letter are ``und`` with score 0.

    The score only weighs the learned languages against each other: ``fits`` is false for texts that are like none of them.
    A model that learned nothing calls everything ``und``. Equal scores go to the language first in code points.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds: list[str] = []
            scores: list[np.ndarray] = []
            fits: list[np.ndarray] = []
            for _, part in _parts(batch["__text"].to_pylist()):
                if held.value.langs:
                    p, s, f = _scored(held.value, part)
                else:
                    p, s, f = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                preds += p
                scores.append(s)
                fits.append(f)
            cols = [batch[k] for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(np.concatenate(fits) if fits else np.zeros(0, bool))], [*keep, "lang_pred", "score", "fits"])

    out = schema.add("lang_pred", "string").add("score", "double").add("fits", "boolean")
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, out)
