"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Documents keep the rates closest to 1 in entropy, sum of r log r - r + 1, of all rates up to ``most`` whose expected words
meet the target of each source. The dual has one multiplier a source, and the rates are exponentially tilted:
r = min(most, exp(multiplier * words / mean words of the source)). As documents of a source with as many words share a
rate, Newton steps run over the histogram (source, words, documents), all sources at once, each step one aggregation; a
bracket holds a step that overshoots. Expected copies are rounded by cumulative sums down the histogram, and up to
``ROUNDS`` single copies per source are then added or taken to close what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, Scratch, lookup_join, partitions, rank_within

#: Newton steps at most, the relative error at which they end, and rounds of single copies.
STEPS, ERROR, ROUNDS = 40, 1e-7, 6


def words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, docs, target): sources by code point, null last, weigh ``weights`` in turn and share all words.

    A target stops at ``most`` times its source's size and the excess is shared anew by weight until none is above.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    # the place of a source: its rank in a range of sources and the sources of the ranges before
    ranged = scratch.save(totals.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    placed = scratch.save(ranged.join(before, "range").withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("range", "before"), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        r = placed.agg(F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, level = r["n"], (total - (r["held"] or 0.0)) / r["open"]
    return placed.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(float(level)))).drop("weight", "cap")


def _tilt(most: float) -> F.Column:
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(50.0)))))


def balance(hist: DataFrame, targets: DataFrame, scratch: Scratch, most: float = 3.0) -> DataFrame:
    """Adds to targets the multiplier ``tilt`` of each source, and ``full`` where every document has the rate ``most``."""
    import math

    mean = F.try_divide("source_size", "docs")
    x0 = F.try_divide(F.col("least"), mean)
    ratio = F.try_divide("target", "source_size")
    less = F.col("target") < F.col("source_size")
    state = targets.withColumn("mean", mean).withColumn("full", F.coalesce(F.col("target") >= most * F.col("source_size") * (1 - 1e-9), F.lit(True)))
    state = state.withColumn("low", F.when(less & (ratio > 0), F.try_divide(F.log(ratio), x0)).otherwise(F.lit(0.0))).withColumn("high", F.when(less, F.lit(0.0)).otherwise(F.try_divide(F.lit(math.log(most)), x0)))
    state = scratch.save(state.withColumn("tilt", F.lit(0.0)), "state")
    size, rate = F.col("size") * F.col("n"), F.col("rate")
    for _ in range(STEPS):
        now = _with(hist, state.select("source", "tilt", "mean", "full")).withColumn("x", F.coalesce(F.try_divide("size", "mean"), F.lit(0.0))).withColumn("rate", _tilt(most))
        got = now.groupBy("source").agg(F.sum(size * rate).alias("got"), F.sum(F.when(rate < most, size * rate * F.col("x")).otherwise(0.0)).alias("slope"))
        miss = F.col("got") - F.col("target")
        low, high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        state = _with(state, got).withColumn("low2", low).withColumn("high2", high).withColumn("far", F.when(F.col("full"), F.lit(0.0)).otherwise(F.try_divide(F.abs(miss), F.col("target"))))
        state = state.withColumn("tilt", F.when(F.col("far") <= ERROR, F.col("tilt")).when(newton.between(F.col("low2"), F.col("high2")), newton).otherwise((F.col("low2") + F.col("high2")) / 2))
        state = scratch.save(state.drop("low", "high", "got", "slope").withColumnsRenamed({"low2": "low", "high2": "high"}), "state")
        if (state.agg(F.max("far")).first()[0] or 0.0) <= ERROR:
            break
    return state.select("source", "source_size", "docs", "target", "mean", "tilt", "full")


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins by source, null to null. The right side has a row a source; a hot source has a row a distinct size at the left."""
    other = right.withColumnRenamed("source", "__s")
    return left.join(other, left["source"].eqNullSafe(other["__s"]), "left").drop("__s")


def class_copies(hist: DataFrame, tilted: DataFrame, scratch: Scratch, most: float = 3.0) -> DataFrame:
    """(source, size, n, copies): whole copies that the documents of a class get together."""
    desired = _with(hist, tilted).withColumn("x", F.coalesce(F.try_divide("size", "mean"), F.lit(0.0))).withColumn("want", _tilt(most) * F.col("n"))
    desired = scratch.save(desired.withColumn("band", F.floor(4 * F.log2(F.col("size") + 1.0))).select("source", "size", "n", "want", "band", "target"), "want")
    bands = desired.groupBy("source", "band").agg(F.sum("want").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(F.col("source").alias("__s"), F.col("band").alias("__b"), "before")
    here = Window.partitionBy("source", "band").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = desired.withColumn("upto", F.sum("want").over(here)).join(bands, F.col("source").eqNullSafe(F.col("__s")) & (F.col("band") == F.col("__b")))
    end = F.floor(F.col("before") + F.col("upto") + 0.5)
    start = F.floor(F.col("before") + F.col("upto") - F.col("want") + 0.5)
    out = scratch.save(run.withColumn("copies", F.greatest(F.lit(0), F.least(end - start, (F.lit(most) * F.col("n")).cast("long")))).select("source", "size", "n", "copies", "target"), "copies")
    for _ in range(ROUNDS):
        left = out.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("rest"))
        near = _with(out, left).where("size > 0 and size < 2 * abs(rest) and ((rest > 0 and copies < 3 * n) or (rest < 0 and copies > 0))".replace("3 *", f"{most} *"))
        step = near.groupBy("source").agg(F.min_by(F.struct("size", F.signum("rest").cast("long").alias("step")), F.struct(F.abs(F.col("size") - F.abs(F.col("rest"))), F.col("size"))).alias("one")).selectExpr("source __s", "one.size __z", "one.step step")
        step = scratch.save(step, "step")
        if not step.take(1):
            break
        out = scratch.save(out.join(step, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).select("source", "size", "n", "copies", "target"), "copies")
    return out


def mix(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``keep`` columns, size, source_size, target and the whole copies of each document that the mix takes.

    ``docs`` has doc_id, text and source. Sizes are words, null and empty texts have none and no copy. Within a class of equal
    source and size, the documents with the smallest hashes of doc_id get the copies that don't divide evenly. Null sources are a
    source of their own; rows with equal doc_id are taken each by itself.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = ["doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")]]
    sized = scratch.save(docs.withColumn("__size", words()).select(*own, "__size"), "sized")
    hist = scratch.save(sized.groupBy("source", F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "hist")
    targets = scratch.save(source_targets(hist, scratch, weights, most), "targets")
    tilted = balance(hist, targets, scratch, most)
    copies = class_copies(hist, tilted, scratch, most)
    ranked = rank_within(sized, ["source", "__size"], ["doc_id"], "__rank")
    per = copies.selectExpr("source __s", "size __z", "copies div n __each", "copies % n __more")
    return _classes(ranked, per, tilted)


def _classes(ranked: DataFrame, per: DataFrame, tilted: DataFrame) -> DataFrame:
    """A class may hold a third of the rows: its one row is looked up with hot classes dealt out."""
    keyed = ranked.withColumn("__key", F.xxhash64(F.col("source").isNull(), "source", "__size"))
    sources = tilted.selectExpr("source __t", "source_size", "target")
    right = per.join(sources, F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t").withColumn("__key", F.xxhash64(F.col("__s").isNull(), "__s", "__z")).drop("__s", "__z")
    found = lookup_join(keyed, right, ["__key"])
    copies = F.when(F.col("__size") > 0, F.col("__each") + (F.col("__rank") < F.col("__more")).cast("long")).otherwise(0)
    return found.withColumn("copies", copies.cast("long")).withColumnRenamed("__size", "size").drop("__key", "__rank", "__each", "__more")
