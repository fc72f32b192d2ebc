"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first letters, hashed into buckets. The corpus-wide choice of terms (most telling by the labels) is an
aggregation; the machine, weights and ``FACTORS`` factors per chosen term whose products are pairwise interactions, is
fitted on the driver to a bounded sample of labelled rows and broadcast. A document's features are which terms it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .langid import held_out
from .textscan import NOT_LETTER, byte_hash, chunks, mix

#: Hash buckets, chosen terms, rows of either label that are learned from (about; by the hash of doc_id), least labelled rows
#: with a term.
BUCKETS, TERMS, MAX_ROWS, LEAST_ROWS = 1 << 20, 2048, (5_000, 10_000), 3
PREFIXES = (4, 5)
FACTORS, EPOCHS, RATE, DECAY = 8, 40, 0.1, 2e-4


def terms(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, document, bucket) of each distinct term of whole texts; null and empty texts have none."""
    for c in chunks(text, lower=True, space=NOT_LETTER):
        parts = [byte_hash(c.buf, c.start, c.end)]
        docs = [c.doc]
        for n in PREFIXES:
            long = c.end - c.start > n
            parts.append(mix(byte_hash(c.buf, c.start[long], c.start[long] + n) + np.uint64(n)))
            docs.append(c.doc[long])
        bucket = np.concatenate(parts) >> np.uint64(44)
        key = np.unique(np.concatenate(docs).astype(np.uint64) * np.uint64(BUCKETS) + bucket)
        yield c.first, c.n, (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Machine:
    place: np.ndarray  # bucket -> chosen term or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 of n documents, from (document, chosen term), ordered by document."""
        z = np.full(n, self.bias)
        if len(doc):
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            v = self.factors[term]
            sums, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
            z[doc[starts]] += np.add.reduceat(self.weights[term], starts) + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, AdaGrad over batches of 256 rows; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS)), 0.0
    gw, gv, gb = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6), 1e-6
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    each = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            x = np.zeros((len(batch), n_terms))
            for i, r in enumerate(batch):
                x[i, rows[r]] = 1.0
            xv = x @ v
            z = bias + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) * each[batch] / len(batch)
            dw = x.T @ err + DECAY * w
            dv = x.T @ (err[:, None] * xv) - v * (x.T @ err)[:, None] + DECAY * v
            db = err.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, bias = w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), bias - RATE * db / np.sqrt(gb)
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Machine:
    """Learns from labels.toxic of rows that aren't held out; a doc_id with both labels counts as toxic.

    At most about ``max_rows`` toxic and other rows are learned from, by the hash of doc_id: their ids are broadcast, so the
    documents are not shuffled. Without both labels the score is the share of toxic rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Machine(np.full(BUCKETS, -1, np.int32), float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    cut = F.when(F.col("toxic") == 1, F.lit(max_rows[0] / pos)).otherwise(F.lit(max_rows[1] / neg))
    known = known.where(F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64) + 0.5 < cut)
    # about sum(max_rows) rows of 12 bytes
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = np.asarray(batch["toxic"])
            for first, _, doc, bucket in terms(batch["text"]):
                own = toxic[first + doc]
                for k in (0, 1):
                    total[k] += np.bincount(bucket[own == k], minlength=BUCKETS)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["bucket", "pos", "neg"])

    used_pos, used_neg = min(pos, max_rows[0]), min(neg, max_rows[1])
    summed = sample.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_ROWS)
    p, q = (F.col("pos") + 0.5) / (used_pos + 1.0), (F.col("neg") + 0.5) / (used_neg + 1.0)
    telling = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    chosen = [r["bucket"] for r in summed.orderBy(F.desc(telling), "bucket").limit(TERMS).select("bucket").collect()]
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = spark.sparkContext.broadcast(place)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, doc, bucket in terms(batch["text"]):
                term = held.value[bucket]
                doc, term = doc[term >= 0], term[term >= 0].astype("<u2")
                cuts = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(first, n), pa.array([term[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["toxic", "terms"])

    # at most about sum(max_rows) rows of 2 * TERMS bytes
    found = sample.mapInArrow(pick, "toxic int, terms binary").toArrow()
    rows = sorted(zip(found["toxic"].to_pylist(), found["terms"].to_pylist(), strict=True))  # the order of tasks must not matter
    bias, w, v = fit([np.frombuffer(t, "<u2") for _, t in rows], np.array([float(k) for k, _ in rows]), len(chosen))
    return Machine(place, float(bias), w, v)


def classify(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null and empty texts get the score without terms."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for first, n, doc, bucket in terms(batch["text"]):
                term = m.place[bucket]
                score = m.score(doc[term >= 0], term[term >= 0], n)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
