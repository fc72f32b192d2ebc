"""Shared parts of the training-data operators: scratch tables, skew-safe joins, ranks, components."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of every contract: code points outside ASCII white space.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


#: Bytes of a batch that goes to Python, where the session has Spark's default (64 MB: some hundred MB in each worker).
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of a session that leaves their size to Spark; a single row may still be larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one operator run, written as Parquet to the shared folder so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quotewell/{name}-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)
        atexit.register(self.drop, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, table: DataFrame) -> None:
        """Deletes a saved table, and the shuffle files of plans that are gone."""
        for f in {f.rpartition("/")[0] for f in table.inputFiles()[:1]}:
            self.drop(f)
        self.sweep()

    def sweep(self) -> None:
        """Deletes the shuffle files of plans that are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone: whoever owns the folder clears it
            pass


def hot_keys(left: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, least: int = 64) -> list[tuple]:
    """(key..., parts) of keys that hold more than a share of a partition, and than ``least`` rows; at most two a shuffle partition.

    ``counts`` may give the (key..., n) of all keys with more than one row.
    """
    spark = left.sparkSession
    n = 2 * partitions(spark)
    if counts is not None:
        top = counts.select(*keys, F.col("n").alias("__n")).orderBy(F.desc("__n")).limit(n).collect()
        each = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // (2 * n))
        return [(*r[:-1], -(-r["__n"] // each)) for r in top if r["__n"] > each]
    top = left.where(F.concat(*[F.col(k).isNotNull().cast("string") for k in keys]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n")).limit(n).collect()
    if not top or top[0]["__n"] <= least:
        return []
    total = left.count()
    each = max(least, total // (2 * n))
    return [(*r[:-1], -(-r["__n"] // each)) for r in top if r["__n"] > each]


def _small(df: DataFrame) -> bool:
    """Whether the size that Spark knows of a plan is within its limit for broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Joins a left side with repeated keys to a right side whose keys are unique.

    A key that holds many left rows is dealt over several partitions: its right row is repeated for each part and
    every left row goes to one part. Only the (key, parts) list of the hot keys is broadcast, at most twice the number of
    shuffle partitions. Null keys match nothing and are dealt out by the hash of their row.
    """
    spark = left.sparkSession
    if _small(right):  # Spark broadcasts it by the same figure
        return left.join(right, list(keys), how)
    hot = hot_keys(left, keys, counts)
    cols = left.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    if not hot:
        return left.join(right, list(keys), how)
    schema = T.StructType([left.schema[k] for k in keys] + [T.StructField("__parts", T.LongType())])
    parts = F.broadcast(spark.createDataFrame(hot, schema))
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    dealt = left.join(parts, list(keys), "left").withColumn("__part", F.when(some_null, F.pmod(row, F.lit(1 << 20))).otherwise(F.pmod(row, F.coalesce("__parts", F.lit(1))))).drop("__parts")
    spread = right.join(parts, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*keys, "__part"], how).drop("__part")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds a rank from 0, gapless and unique within ``keys``, by the hash of ``order`` and then ``order``.

    No key is gathered in one task: the range of the hash is cut into parts, as many as the key's rows ask for, and a part
    starts where the counts of the parts before it end. Rows that agree in ``order`` may swap their ranks.
    """
    spark = df.sparkSession
    total = max(1, df.count())
    each = max(64, total // (4 * partitions(spark)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > each).collect()  # at most total / each keys: four a shuffle partition
    schema = T.StructType([T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("__parts", T.LongType())])
    parts = F.broadcast(spark.createDataFrame([(*r[:-1], -(-r["__n"] // each)) for r in hot], schema))

    def same(extra: Column | None = None) -> Column:
        on = F.lit(True) if extra is None else extra
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return on

    share = F.col("__h") / F.lit(2.0**64) + F.lit(0.5)
    dealt = df.withColumn("__h", F.xxhash64(*order)).join(parts, same(), "left")
    dealt = dealt.withColumn("__part", F.least(F.floor(share * F.coalesce("__parts", F.lit(1))), F.coalesce("__parts", F.lit(1)) - 1)).select(*df.columns, "__h", "__part")
    sizes = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.where("__part > 0").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__start")
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__h", *order)) - 1)
    # starts has a row only for parts of hot keys: at most eight a shuffle partition
    return ranked.join(F.broadcast(starts), same(F.col("__part") == F.col("__p")), "left").withColumn(out, (F.col("__r") + F.coalesce("__start", F.lit(0))).cast("long")).select(*df.columns, out)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (u, v) reaches. Nodes are longs.

    Each round hooks a label to its smallest neighbour, shortcuts twice, and contracts the edges, until no edge joins two
    labels. A third of all edges may meet in one node: every lookup deals hot keys out.
    """
    edges = scratch.save(edges.where("u <> v").selectExpr("least(u, v) u", "greatest(u, v) v").distinct(), "edges")
    labels = scratch.save(edges.selectExpr("explode(array(u, v)) node").distinct().withColumn("label", F.col("node")), "labels")
    while edges.take(1):
        both = edges.union(edges.selectExpr("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u label", "least(u, v) hooked")
        hook = scratch.save(hook, "hook")
        for _ in range(2):
            up = hook.selectExpr("label hooked", "hooked up")
            hook = scratch.save(lookup_join(hook, up, ["hooked"]).selectExpr("label", "coalesce(up, hooked) hooked"), "hook")
        labels = scratch.save(lookup_join(labels, hook, ["label"]).selectExpr("node", "coalesce(hooked, label) label"), "labels")
        edges = lookup_join(edges, hook.selectExpr("label u", "hooked a"), ["u"]).selectExpr("v", "coalesce(a, u) u2")
        edges = lookup_join(edges, hook.selectExpr("label v", "hooked b"), ["v"]).selectExpr("u2", "coalesce(b, v) v2")
        edges = scratch.save(edges.where("u2 <> v2").selectExpr("least(u2, v2) u", "greatest(u2, v2) v").distinct(), "edges")
    return labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
