import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quotewell.llm.common import Scratch
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_groups


def test_stages_match_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "12 34", "en", "src0", 5), (900_003, "", None, None, 0), (None, docs.first().text, None, None, 3)], docs.schema)
    given = scratch.save(docs.union(extra), "docs")
    outs = []
    now = given
    for name, stage in cp.STAGES:
        now = scratch.save(stage(spark, now, sf), name)
        outs.append(now.collect())
        if name != "pack":
            assert now.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in outs[-1])
    ids = [r.doc_id for r in outs[0]]
    assert not {900_001, 900_002, 900_003} & set(ids)
    clean = [r for r in given.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert len(ids) == len(clean)
    lines = [(d, t) for d, t, _, removed in brute_lines([(r.doc_id, r.text) for r in outs[0]], 1) if removed is None or t.strip(" \t\n\r\v\f")]
    assert sorted(((r.doc_id, r.text) for r in outs[1]), key=str) == sorted(lines, key=str)
    groups = [d for d, _, _, kept in brute_groups([(r.doc_id, r.text) for r in outs[1]], 5) if kept and d is not None]
    assert sorted(r.doc_id for r in outs[2] if r.doc_id is not None) == groups or sorted(groups) == sorted(r.doc_id for r in outs[2] if r.doc_id is not None)
    copies = {}
    for r in outs[3]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= {r.doc_id for r in outs[2]} and max(copies.values()) <= 3
    tokenizer, text = Tokenizer.from_file(cp.TOKENIZER), {r.doc_id: r.text for r in outs[3]}
    seen = {}
    for r in outs[4]:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        if r.start == 0 and r.length == r.doc_tokens:
            own = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
            assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
    for d, n in copies.items():
        assert seen[d] == n * (len(tokenizer.encode(text[d], add_special_tokens=False).ids) + 1)
    assert cp.run(spark, sf).count() > 0


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    others = ["Быстрая коричневая лиса прыгает через ленивую собаку", "今日は良い天気ですね散歩に行きましょう", "η γρήγορη καφέ αλεπού πηδάει πάνω", "Москва"]
    extra = spark.createDataFrame([(900_001 + i, t, None, "src0", len(t)) for i, t in enumerate(others)], docs.schema)
    kept = {r.doc_id for r in cp.language_id(spark, docs.union(extra), "").collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_short_repeated_lines_go(spark):
    rows = [(1, "Les.\nAll rights reserved.\nLes."), (2, "all rights reserved.\nnew"), (3, "les."), (4, " ")]
    docs = spark.createDataFrame([(d, t, "fr", "src0", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in cp.line_dedup(spark, docs, "").collect()) == [(1, "Les.\nAll rights reserved."), (2, "new"), (4, " ")]
