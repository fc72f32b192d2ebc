import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewell.llm import packing, tokenfile
from quotewell.llm.common import Scratch
from quotewell.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, ids string"
TEXTS = ["", None, "Hello  World's\n<|endoftext|> 12é É ΑΣ x y z", "a" * 9000, "Quees ciónción " * 3000, "tab\tand\x0bvt \x1c sep", "the the", "the the"]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_is_the_tokenizer():
    rng = random.Random(3)
    encoder = WordEncoder(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "'s", "É", "é", "1", "<|endoftext|>", "\t", "ß", ".", "Σ", "́"]) for _ in range(30))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plan_places_every_rank_once_without_overlap():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        taken = {}
        for length, rank, n, first, offset in packing.plan(histogram, 64):
            for i in range(n):
                taken.setdefault(first + i, []).append((offset, length))
                histogram[length] -= 1
        assert not any(histogram.values())
        assert sorted(taken) == list(range(len(taken)))
        for spans in taken.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 64


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, ""), (3, "same id", 1, "")] + [(100 + i, "copy of it", 0, "") for i in range(300)], SCHEMA)
    scratch = Scratch(spark, "t")
    pieces = scratch.save(packing.tokenized_pieces(docs, PATH, 2, 256), "pieces")
    rows = packing.pack(pieces, scratch, 256).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in enumerate(TEXTS):
        want = ids_of(text) + [2]
        assert [x for _, p in sorted(got[i, len(want)]) for x in p] == want
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    used = sum(r.length for r in rows)
    assert used / (256 * len(sequences)) > 0.9
    assert packing.pack(scratch.save(pieces.limit(0), "none"), scratch, 256).count() == 0


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(7 * i % 97, t, 1, "") for i, t in enumerate(TEXTS * 9)] + [(None, "x y", 1, ""), (None, None, 1, "")], SCHEMA)
    scratch = Scratch(spark, "t")
    manifest = scratch.save(tokenfile.write_shards(docs, f"{scratch.root}/s", PATH, 1), "m")
    rows = sorted(tokenfile.read_shards(manifest).collect(), key=lambda r: r.start)
    want = sorted(((-1 if d.doc_id is None else d.doc_id, tuple(ids_of(d.text) + [1])) for d in docs.collect()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == sorted(w[0] for w in want)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = spark.createDataFrame([(7,), (7,), (10**9,), (None,)], "doc_id long")
    found = tokenfile.fetch(manifest, keys).collect()
    assert {zlib.crc32(r.ids) for r in found} == {zlib.crc32(r.ids) for r in rows if r.doc_id == 7}
    assert tokenfile.write_and_read(docs.limit(0), PATH).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = tokenfile.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(5000))


def test_op1_and_op2_on_real_rows(spark):
    from quotewell.llm.queries import op1_packing, op2_token_files

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_token_files(spark, sf).where("doc_id % 10 = 0").collect():
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids_of(docs[r.doc_id]) + [1], "<u4").tobytes())
    rows = op1_packing(spark, sf).select(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert rows.n / (rows.s * 4096) > 0.9
