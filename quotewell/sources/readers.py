"""Sources: delimited and JSON texts, archive members, depth workbooks, canonical Parquet."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import plain


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, names: list[str], header: bool = False, separator: str = ",", max_chars: int = 1 << 20) -> DataFrame:
    """Declared columns as text, plain or gzip; rows that don't fit are kept under _corrupt_record."""
    schema = strings([*names, "_corrupt_record"])
    return spark.read.schema(schema).option("header", header).option("sep", separator).option("mode", "PERMISSIVE").option("maxCharsPerColumn", max_chars).option("enforceSchema", not header).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line; number fields declared as STRING keep all digits."""
    return spark.read.schema(schema).option("primitivesAsString", True).option("mode", "PERMISSIVE").json(path)


def bounded(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Marks records over ``limit`` bytes."""
    return df.withColumn("oversized", F.octet_length(column) > limit)


def _members(name: str, data: bytes) -> Iterator[tuple[int, str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i, info in enumerate(z.infolist()):
                if not info.is_dir():
                    yield i, info.filename, z.read(info)
    elif name.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for i, info in enumerate(t):
                if info.isfile():
                    yield i, info.name, t.extractfile(info).read()
    elif name.endswith(".gz"):
        yield 0, name.rpartition("/")[2][:-3], gzip.decompress(data)
    else:
        yield 0, name.rpartition("/")[2], data


def read_members(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(path, member_ordinal, member, line_number, line) of plain, gzip, zip and tar.gz files, in member order.

    ``member`` is a regular expression of wanted names. A file is one task's work; archives are read by any store that Spark reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for i, inner, raw in _members(name, data):
                    if member is None or re.search(member, inner):
                        lines = raw.decode("utf-8", "replace").split("\n")
                        lines = lines[:-1] if lines and not lines[-1] else lines
                        yield pd.DataFrame({"path": name, "member_ordinal": i, "member": inner, "line_number": range(len(lines)), "line": [x.rstrip("\r") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member_ordinal int, member string, line_number long, line string")


def split_lines(lines: DataFrame, names: list[str], separator: str = ",") -> DataFrame:
    """Delimited lines of read_members as text columns."""
    parsed = F.from_csv("line", strings(names).simpleString()[7:-1].replace(":", " "), {"sep": separator})
    return lines.withColumn("__r", parsed).select("path", "member", "member_ordinal", "line_number", "__r.*")


def _sheet(data: bytes) -> list[list[str | None]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rows = []
        for row in ElementTree.fromstring(z.read(next(n for n in sorted(names) if n.startswith("xl/worksheets/sheet")))).iter(f"{ns}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{ns}c"):
                letters = re.match("[A-Z]+", c.get("r", "")) or None
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells.append(text)
            rows.append(cells)
        return rows


def read_depth_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_ordinal, timestamp, asks, bids) of workbooks with those three columns under a header row, as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, i, *(r + [None] * 3)[:3]) for i, r in enumerate(_sheet(data)[1:])]
                yield pd.DataFrame(rows, columns=["path", "source_ordinal", "timestamp", "asks", "bids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, source_ordinal long, timestamp string, asks string, bids string")


def read_canonical(spark: SparkSession, *paths: str, start: int | None = None, end: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Canonical Parquet with the time range and columns pushed to the scan."""
    df = spark.read.parquet(*paths)
    if start is not None:
        df = df.where(F.col("event_timestamp_ns") >= start)
    if end is not None:
        df = df.where(F.col("event_timestamp_ns") < end)
    return df.select(*columns) if columns else df


def read_wide_decimals(spark: SparkSession, path: str) -> DataFrame:
    """Parquet whose decimals are wider than Spark's: those columns become exact text. A file is one task's work."""
    first = spark.read.format("binaryFile").load(path).limit(1).select("content").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = pq.read_schema(pa.BufferReader(first["content"]))
    fields = [pa.field(f.name, pa.string() if pa.types.is_decimal(f.type) and f.type.precision > 38 else f.type) for f in schema]
    target = pa.schema(fields)
    empty = spark.createDataFrame(target.empty_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for part in pq.ParquetFile(pa.BufferReader(content.as_py())).iter_batches():
                    cols = [pa.array([None if v is None else plain(v) for v in part[f.name].to_pylist()], pa.string()) if f.type != part[f.name].type else part[f.name] for f in target]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, empty.schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of a tree's files, from the listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def footer(path: str) -> dict:
    """Rows, row groups and columns of one Parquet file, from its footer."""
    meta = pq.ParquetFile(path).metadata
    return {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": meta.num_columns, "bytes": sum(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))}
