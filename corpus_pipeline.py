"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewell.llm import langid, linededup, mixing, neardup, packing
from quotewell.llm.common import Scratch
from quotewell.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores below it are no decision for a language: the document goes.
LEAST_SCORE = 0.4


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized, under that language; null texts, texts without a letter and texts that are like
    none of the learned languages go.
    """
    model = langid.train(docs)
    found = langid.identify(docs, model, tuple(COLUMNS))
    return _sized(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & F.col("fits")).withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are similar to earlier ones; documents that lose all their words go."""
    found = linededup.dedup_lines(docs.select(*COLUMNS))
    return _sized(found.where(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id, null last, of each group of near-duplicates (five words, a similarity of 0.8).

    Of rows that repeat doc_id and text, one stays; documents without words are groups by themselves.
    """
    found = neardup.grouped(docs, k=5, least=0.8)
    kept = Scratch(spark, "kept").save(found.where("kept").groupBy("rk").agg(F.count_if(F.col("n_shingles") > 0).alias("n")), "kept")
    keyed = docs.withColumn("rk", neardup.row_key())
    once = keyed.join(kept.where("n <= 1"), "rk", "left_semi")
    repeated = keyed.join(kept.where("n > 1"), "rk", "left_semi").dropDuplicates(["rk"])
    return _sized(once.unionByName(repeated))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; documents without a copy go."""
    found = mixing.mix(docs.select(*COLUMNS), COLUMNS)
    return _sized(found.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequence and offset; copies of a document are packed each by itself."""
    scratch = Scratch(spark, "pack")
    pieces = packing.tokenized_pieces(docs, TOKENIZER)
    pieces = scratch.save(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces, scratch).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Two stages learn or sketch: SQL can't express them, and the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
