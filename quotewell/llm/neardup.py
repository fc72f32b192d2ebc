"""Near-duplicate documents by SetSketch registers.

A register of a document is the truncated, exponentially spaced minimum of its shingles' hashes: K = floor(1 - log_B(h / A)) for
the smallest exponential variate h, which merges by maximum and is equal in two documents about as often as they share
shingles. Bands of registers name buckets; each bucket is a star around one of its members, chosen in one of ``CENTRES`` ways by its band. Pairs pass
the joint likelihood of their registers, then the Jaccard similarity of the full sets. What stays in other components of a
bucket after the stars is compared with the whole bucket, block by block, so that a star's centre decides no link.

Documents of one set are one class, and only classes are compared; nodes are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lookup_join
from .textscan import chunks, rolling

#: Base and rate of the registers; bands and registers a band. At a similarity of 0.8 all bands miss once in 80,000 pairs.
BASE, RATE, BANDS, ROWS = 1.001, 20.0, 48, 7
M = BANDS * ROWS
#: A pair whose most likely similarity is this many standard errors below the limit is not verified.
ERRORS = 4.0
#: Choices of a star's centre among the bands.
CENTRES = 16
#: Members of a bucket that make a block.
BLOCK = 256
#: Buckets of the filter that says whose sets are read again.
FILTER = 1 << 21
_RNG = np.random.Generator(np.random.PCG64(77))
_SEEDS = _RNG.integers(0, 1 << 32, M, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct hashes of each document's shingles of k words), a chunk at a time.

    Words are lower-cased in A-Z. Fewer words than k are one shingle; no word, null or empty text give the empty set.
    """
    for c in chunks(text, lower=True):
        h = c.hashes()
        first = np.searchsorted(c.doc, np.arange(c.n + 1))
        grams = rolling(h, k)
        short = {m: rolling(h, m) for m in range(1, k)}
        out = []
        for i in range(c.n):
            a, b = first[i], first[i + 1]
            out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else short[b - a][a : a + 1] if b > a else grams[:0])
        yield c.first, out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes; the sketch of a union is the maximum of the sketches."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        v = x[at : at + 1024, None] ^ _SEEDS
        v *= _ODD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(low, v.min(0), out=low)
    h = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65534).astype("<u2")


def likely_similarity(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of highest likelihood, from the numbers of registers in which a is greater and smaller than b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = M - greater - smaller
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    dp = lambda x: (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(40):  # the derivative of the log-likelihood falls
            j = (low + high) / 2
            x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
            a, b = -v * dp(x), -u * dp(y)
            slope = greater * a / p(x) + smaller * b / p(y) - equal * (a + b) / np.maximum(1 - p(x) - p(y), 1e-12)
            up = slope > 0
            low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def row_key() -> Column:
    """A key of rows (doc_id, text) that is never null; rows that repeat both are one document."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, rk, n, fp, regs): row key, size, hash and registers of each document's set; fp and regs are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch["text"], k):
                fp = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
                regs = [registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(sets)), batch["rk"].slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "rk", "n", "fp", "regs"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), "text").mapInArrow(run, "doc_id long, rk long, n long, fp long, regs binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, est) of pairs whose sizes and registers leave a similarity of ``least`` possible."""
    floor = least - ERRORS * (least * (1 - least) / M) ** 0.5
    sized = lookup_join(pairs, classes.selectExpr("fp a", "n na", "regs ra"), ["a"], "inner")
    sized = sized.join(classes.selectExpr("fp b", "n nb", "regs rb"), "b")
    sized = sized.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra, rb = (np.frombuffer(b"".join(part[c].to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
                est = likely_similarity((ra > rb).sum(1), (ra < rb).sum(1), np.asarray(part["na"]).astype(float), np.asarray(part["nb"]).astype(float))
                ok = est >= floor
                yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(ok)), part["b"].filter(pa.array(ok)), pa.array(est[ok])], ["a", "b", "est"])

    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, est double")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(fp, items) of the wanted (fp, rk): sets of the representatives' texts, read again.

    A filter of ``FILTER`` bits on the row key is all that is broadcast; documents that it lets pass in vain fall out in the join.
    """
    spark = docs.sparkSession
    bucket = F.pmod(row_key(), F.lit(FILTER))
    bits = np.zeros(FILTER, bool)
    found = wanted.select(F.pmod("rk", F.lit(FILTER)).alias("b")).distinct().toArrow()["b"].to_numpy()  # at most FILTER rows
    bits[found] = True
    held = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(passed[np.asarray(batch["b"])]))
            for _, sets in shingle_sets(batch["text"], k):
                sets = [s for s in sets if len(s)]
                fp = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "items"])

    sets = docs.select(bucket.alias("b"), "text").mapInArrow(run, "fp long, items binary")
    return sets.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets are similar enough."""
    percent = round(100 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok, pa.bool_())), batch["b"].filter(pa.array(ok, pa.bool_()))], ["u", "v"])

    both = lookup_join(pairs.select("a", "b"), sets.selectExpr("fp b", "items sb"), ["b"], "inner")
    both = lookup_join(both, sets.selectExpr("fp a", "items sa"), ["a"], "inner")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def _labelled(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return lookup_join(df, labels.selectExpr(f"node {node}", "label __label"), [node]).withColumn(out, F.coalesce("__label", node)).drop("__label")


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that similar texts reach; a document without words is its own. A null doc_id is never
    the smallest: its component_id is that of the others, or null where all are null. Rows that repeat a doc_id are compared
    each by itself. One document of a component is kept: of those with its smallest doc_id, or of nulls only, the one with the
    smallest ``row_key``; rows that repeat doc_id and text are one document.
    """
    return grouped(docs, k, least).drop("rk")


def grouped(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """``near_duplicates`` with each row's key rk."""
    scratch = Scratch(docs.sparkSession, "neardup")
    sketched = scratch.save(sketches(docs, k), "sketches")
    rows = scratch.save(sketched.select("doc_id", "rk", "n", "fp"), "rows")
    classes = scratch.save(sketched.where("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rk")).alias("rep"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs")), "classes")
    scratch.forget(sketched)
    bands = classes.select("fp", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])).alias("band", "key"))
    # min(fp ^ salt) ^ salt is a member chosen by the salt: bands take turns with ``CENTRES`` of them, the same in large groups
    buckets = scratch.save(bands.withColumn("salt", F.xxhash64(F.col("band") % CENTRES)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("fp ^ salt")).alias("m"), F.any_value("salt").alias("salt")).where("n > 1").selectExpr("key", "n", "m ^ salt centre"), "buckets")
    members = scratch.save(lookup_join(bands, buckets, ["key"], "inner", buckets), "members")
    scratch.forget(buckets)
    stars = scratch.save(members.where("fp <> centre").selectExpr("centre a", "fp b").distinct(), "stars")
    likely = scratch.save(_estimated(stars, classes, least), "likely")
    scratch.forget(stars)
    wanted = likely.selectExpr("explode(array(a, b)) fp").distinct().join(classes.select("fp", "rep.rk"), "fp")
    sets = scratch.save(full_sets(docs, wanted, k), "sets")
    # first the likeliest centre of each, then what still lies in two components
    best = likely.groupBy("b").agg(F.max_by("a", "est").alias("a"))
    links = scratch.save(_verified(best, sets, least), "links")
    labels = components(scratch, links)
    open_ = _labelled(_labelled(likely.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")
    more = scratch.save(_verified(scratch.save(open_, "open"), sets, least), "links")
    scratch.forget(sets)
    if more.take(1):
        links = links.union(more)
        labels = components(scratch, links)
    more = scratch.save(_residual(docs, members, labels, classes, scratch, k, least), "links")
    if more.take(1):
        labels = components(scratch, links.union(more))
    scratch.forget(members)
    named = _labelled(classes.select("fp", "rep"), labels, "fp", "label")
    least_id = named.groupBy("label").agg(F.min("rep").alias("first"))
    of_class = scratch.save(lookup_join(named, least_id, ["label"]).selectExpr("fp", "first.doc_id component_id", "first.rk kept_rk"), "of_class")
    out = lookup_join(rows.select("doc_id", "rk", "n", "fp"), of_class, ["fp"])
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("fp").isNull() | F.col("rk").eqNullSafe(F.col("kept_rk"))
    return out.select("rk", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _residual(docs: DataFrame, members: DataFrame, labels: DataFrame, classes: DataFrame, scratch: Scratch, k: int, least: float) -> DataFrame:
    """(u, v) links that no star has found: members outside a bucket's main component against its members elsewhere.

    A bucket is cut into blocks of about ``BLOCK`` members with their full sets; a row pairs two blocks. Of its pairs, those that
    the registers leave likely are verified, in the first of the buckets that they share, until the member has a link to the
    other's component: further ones join nothing new. Pairs never become rows.
    """
    held = scratch.save(_labelled(members.select("key", "band", "fp", F.col("n").alias("of")), labels, "fp", "label"), "held")
    mixed = held.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    per = held.join(mixed, "key", "left_semi").groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = scratch.save(per.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("n")), "main")
    own = scratch.save(lookup_join(held, main.select("key", "main", "n"), ["key"], "inner", main).selectExpr("key", "band", "fp", "label", "main", f"(of + {BLOCK - 1}) div {BLOCK} parts"), "own")
    scratch.forget(held)
    wanted = scratch.save(own.select("fp").distinct().join(classes, "fp"), "contested")
    sets = scratch.save(full_sets(docs, wanted.select("fp", "rep.rk"), k).join(wanted.selectExpr("fp", "n size", "regs"), "fp"), "sets")
    own = lookup_join(own, sets, ["fp"], "inner").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    one = F.struct("fp", "label", "size", "regs", "items")
    blocks = scratch.save(own.groupBy("key", "part", "band", "main", "parts").agg(F.collect_list(one).alias("all")), "blocks")
    scratch.forget(sets)
    few = F.filter("all", lambda x: x["label"] != F.col("main"))
    left = blocks.withColumn("few", few).where(F.size("few") > 0).select("key", "band", "main", "few", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    floor, percent = least - ERRORS * (least * (1 - least) / M) ** 0.5, round(100 * least)

    def fields(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        own = column[row].values
        sets = [np.frombuffer(x, np.uint64) for x in own.field("items").to_pylist()]
        return (*(np.asarray(own.field(c)) for c in ("fp", "label", "size")), np.frombuffer(b"".join(own.field("regs").to_pylist()), "<u2").reshape(-1, M), sets)

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                band, main = batch["band"][row].as_py(), batch["main"][row].as_py()
                fa, la, na, ra, sa = fields(batch["few"], row)
                fb, lb, nb, rb, sb = fields(batch["all"], row)
                links = []
                for i in range(len(fa)):
                    close = (lb != la[i]) & ((lb == main) | (fb > fa[i])) & (np.minimum(nb, na[i]) >= least * np.maximum(nb, na[i]) - 1e-9)
                    j = np.flatnonzero(close)
                    same = ra[i] == rb[j]
                    shared = same.reshape(-1, BANDS, ROWS).all(2)
                    # the share of equal registers estimates the similarity; its likelihood is asked where that is near the limit
                    near = (same.sum(1) >= 0.9 * floor * M) & (shared.argmax(1) == band)
                    j = j[near]
                    if not len(j):
                        continue
                    est = likely_similarity((ra[i] > rb[j]).sum(1), (ra[i] < rb[j]).sum(1), np.full(len(j), float(na[i])), nb[j].astype(float))
                    done = set()
                    for e, x in sorted(zip(-est, j.tolist(), strict=True)):
                        if -e < floor:
                            break
                        if lb[x] not in done and alike(sa[i], sb[x]):
                            done.add(lb[x])
                            links.append((int(fa[i]), int(fb[x])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return left.join(blocks.select("key", "part", "all"), ["key", "part"]).select("band", "main", "few", "all").mapInArrow(run, "u long, v long")
