"""Sinks: ordered Parquet, manifests, and commits that appear whole or not at all."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(df: DataFrame, path: str, order: list[str], rows_per_file: int = 5_000_000, partition_by: list[str] | None = None) -> dict:
    """Writes beside the target, sorted within files, with a manifest, then renames; an existing target is refused.

    The manifest has rows, times, schema and a fingerprint of the content that doesn't depend on files or order.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.staging"
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging), True)
    writer = df.sortWithinPartitions(*order).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    written = spark.read.parquet(staging)
    h = F.xxhash64(*[F.col(c) for c in sorted(written.columns)])
    one = written.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor")).first()
    manifest = {"rows": one["rows"], "schema": json.loads(df.schema.json()), "fingerprint": hashlib.sha256(f"{one['rows']}:{one['sum']}:{one['xor']}".encode()).hexdigest()}
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/_manifest.json"), True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging), target):
        raise FileExistsError(path)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, where = _fs(spark, f"{path}/_manifest.json")
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def append_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """An immutable snapshot of a ranking: written once under its id."""
    df.write.mode("errorifexists").parquet(f"{path}/snapshot_id={snapshot_id}")


def record_batches(path: str, keys: list[str]):
    """For foreachBatch: each micro-batch has a folder of its own, so a replay rewrites it and never duplicates."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
