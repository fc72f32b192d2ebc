"""The queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdedup, langid, linededup, mixing, neardup, packing, quality, tokenfile, toxicity, warc
from .common import Scratch, table

#: Where the public tokenizer's file is; a parameter of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), TOKENIZER)
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces, scratch).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfile.write_and_read(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.write_and_read(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition(table(spark, sf_dir, "documents"), first_too=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_ngram_chars")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, least=0.8)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id", "source"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed", "text")


def op10_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_token_files, op3_warc, op4_quality, op5_neardup, op6_mixing, op7_langid, op8_toxicity, op9_linededup, op10_embdedup)}


_REACH = """reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

_OP5 = f"""WITH RECURSIVE text AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM text),
gram AS (SELECT doc_id, n, k, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM word),
item AS (SELECT DISTINCT doc_id, g FROM gram WHERE k <= greatest(n - 3, 1)),
size AS (SELECT doc_id, count(*) AS n FROM item GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM item x JOIN item y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
node AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN size USING (doc_id) JOIN part ON part.id = d.doc_id"""

_OP10 = f"""WITH RECURSIVE given AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM given WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(v, lambda x: x * x), 'sum') > 0),
link AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
many AS (SELECT a AS id, count(*) AS n FROM link GROUP BY 1),
node AS (SELECT id FROM given), {_REACH}
SELECT given.id AS vec_id, coalesce(many.n, 0) AS n_links, component_id, given.id = component_id AS kept FROM given LEFT JOIN many USING (id) JOIN part USING (id)"""

#: The alphabet of base32.
_OP3 = """WITH page AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, lower(trim(coalesce(url, ''))) AS u FROM pages),
part AS (SELECT *, sha1(html) AS hex, split_part(regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':', 1) AS host,
regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS query,
row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth, min(page_id) OVER (PARTITION BY html) AS first FROM page)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to,
CASE WHEN host = '' THEN lower(url) ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key
FROM part"""


def _covered_sql(n: int) -> str:
    """Characters of the words in n-grams that occur twice or more in a text, and the number of those words."""
    return f"""gram{n} AS (SELECT doc_id, k, size, CASE WHEN k <= n - {n - 1} THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g FROM word),
twice{n} AS (SELECT doc_id, k, size, CAST(g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS INT) AS twice FROM gram{n}),
inside{n} AS (SELECT doc_id, size, max(twice) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM twice{n}),
cover{n} AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS words, CAST(sum(inside * size) AS BIGINT) AS chars FROM inside{n} GROUP BY 1)"""


def _op4_sql() -> str:
    word = "[^\\x20\\x09-\\x0D]+"
    lengths = sorted(quality.NGRAM_LIMITS)
    chars = {n: f"coalesce(cover{n}.chars, 0)" for n in lengths}
    over = " AND ".join(f"{chars[n]} <= CAST({quality.NGRAM_LIMITS[n]} AS DOUBLE) * word_chars" for n in lengths)
    return f"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
list AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w FROM doc),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM list),
word AS (SELECT doc_id, n, w, k, length(w) AS size FROM (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM list)),
{", ".join(_covered_sql(n) for n in (3, *lengths))},
cut AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM doc)),
line AS (SELECT doc_id, length(array_to_string(regexp_extract_all(line, '{word}'), '')) AS size, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM cut WHERE regexp_matches(line, '{word}')),
again AS (SELECT doc_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM line WHERE nth > 1 GROUP BY 1),
told AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(again.n, 0) AS n_dup_lines, coalesce(cover3.words, 0) AS n_repeat_words, coalesce(again.chars, 0) AS dup_line_chars, [{", ".join(chars.values())}] AS dup_ngram_chars, {over} AS few
FROM base LEFT JOIN again USING (doc_id) {" ".join(f"LEFT JOIN cover{n} USING (doc_id)" for n in (3, *lengths))}),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND few AND dup_line_chars <= CAST({quality.LINE_LIMIT} AS DOUBLE) * word_chars AS kept, dup_line_chars, dup_ngram_chars FROM judged"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose results are decided by the data alone and that DuckDB can compute on whole small tables."""
    return {"op3_warc": _OP3, "op4_quality": _op4_sql(), "op5_neardup": _OP5, "op10_embdedup": _OP10}
