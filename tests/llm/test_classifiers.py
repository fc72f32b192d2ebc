import random
import zlib

import numpy as np
import pyarrow as pa

from quotewell.llm import langid, toxicity
from quotewell.llm.queries import op7_langid, op8_toxicity

SF = "/root/testdata/sf0.01"


def test_grams_match_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÉé1 ,中\n") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", "a", "12 .", None]
    doc, bucket, count, letters = langid.grams(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in (t or "").lower()) for t in texts]
    alone = [dict(zip(zip(*langid.grams([t])[:2]), langid.grams([t])[2])) for t in texts]
    for i in range(len(texts)):
        assert {b: c for d, b, c in zip(doc, bucket, count) if d == i} == {b: c for (_, b), c in alone[i].items()}


def test_scores_match_brute_force_naive_bayes():
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y", "z"], np.log(rng.random((langid.BUCKETS, 3))).astype(np.float32), np.log([0.2, 0.3, 0.5]))
    texts = ["some words here", "", "é" * 500, "ab 12 cd"]
    preds, scores = langid.score_texts(model, texts)
    for t, p, s in zip(texts, preds, scores):
        _, bucket, count, letters = langid.grams([t])
        if not letters[0]:
            assert (p, s) == ("und", 0.0)
            continue
        z = model.prior.copy()
        for b, c in zip(bucket, count):
            z = z + c * model.log_prob[b] * min(langid.EVIDENCE, count.sum()) / count.sum()
        post = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert p == model.langs[int(post.argmax())] and abs(s - post.max()) < 1e-5


def test_language_held_out_accuracy_and_edges(spark):
    got = op7_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "123 !", "en", 1), (None, "the words and", None, 1), (3, "the " * 100_000, "en", 1), (3, "the " * 100_000, "en", 1)], "doc_id long, text string, lang string, score int")
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert (1, "und", 0.0) in rows and (2, "und", 0.0) in rows
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_many_languages_and_counts_match_plain_ones(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(30)) + f" {chr(0x4E00 + i % 600) * 20}", f"l{i % 600:03d}", 1) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, fits int").repartition(4)
    model = langid.train(docs)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert model.langs == sorted({r[2] for r in learned}) and len(model.langs) > 512
    lang = model.langs[300]
    counts = np.zeros(langid.BUCKETS)
    for _, t, own, _ in learned:
        if own == lang:
            _, bucket, count, _ = langid.grams([t])
            np.add.at(counts, bucket, count)
    assert np.abs(model.log_prob[:, 300] - np.log((counts + 0.5) / (counts + 0.5).sum())).max() < 1e-5
    got = langid.identify(docs, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 600:03d}" for r in got) > 0.95 * len([r for r in rows if r[2] in model.langs])


def test_factorization_learns_a_pair_that_weights_alone_miss():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        own = set(rng.integers(2, 30, 4).tolist()) | ({0} if rng.random() < 0.5 else set()) | ({1} if rng.random() < 0.5 else set())
        rows.append(np.array(sorted(own)))
        labels.append(float({0, 1} <= own or not ({0, 1} & own)))  # exclusive nor: no additive weights tell it
    labels = np.array(labels)
    bias, w, v = toxicity.fit(rows, labels, 30)
    m = toxicity.Machine(np.zeros(0, np.int32), bias, w, v)
    doc, term = np.repeat(np.arange(3000), [len(r) for r in rows]), np.concatenate(rows)
    score = m.score(doc, term, 3000)
    assert ((score > 0.5) == (labels == 1)).mean() > 0.95
    i = 7  # the score of a row from its definition
    z = bias + w[rows[i]].sum() + sum(v[a] @ v[b] for a in rows[i] for b in rows[i] if a < b)
    assert abs(score[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_held_out_accuracy_and_edges(spark):
    got = op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r for r in got if r.held_out and r.toxic == 0]
    toxic = [r for r in got if r.held_out and r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)  # 33 toxic rows to learn from, in four languages
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x " * 200_000, 1), (3, "some text", 1), (3, "some text", 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (3, 0, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.classify(docs, toxicity.train(docs, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.classify(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_terms_are_words_and_their_beginnings():
    (_, n, doc, bucket), = toxicity.terms(pa.array(["Words, words", None, "word"]))
    assert n == 3 and sorted(doc) == [0, 0, 2]  # 'words' and its first four letters; 'word' is not longer than four
