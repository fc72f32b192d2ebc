import random
import re

import numpy as np
import pytest

from quotewell.llm import linededup


def brute(rows, least_words, tenths=8):
    """(doc_id, text, removed) of each row, by all pairs of lines in order; rows that repeat both are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = []
    for d in docs:
        for k, line in enumerate((d[1] or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if len(words) >= least_words:
                lines.append((d, k, words))
    gone = {}
    for i, (d, k, w) in enumerate(lines):
        if any(10 * len(w & v) >= tenths * len(w | v) for _, _, v in lines[:i]):
            gone.setdefault(d, set()).add(k)
    out = []
    for d in rows:
        lost = gone.get(d)
        text = d[1] if not lost else "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in lost)
        out.append((d[0], text, (d[1] or "").count("\n") + 1, sorted(lost) if lost else None))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)]
    pool = []
    for _ in range(60):
        line = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 9, 15, 40, 120]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = list(line)
            for _ in range(rng.randint(0, 1 + len(own) // 10)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            pool.append(" ".join(own))
    rows = [(i, "\n".join(rng.choice(pool + ["", " "]) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(500 + i, f"one very common line of many copies v{i % 40} stays\nnever again this one x{i}") for i in range(400)]
    return rows + [(7, "a row of an id that is there twice already"), (None, rng.choice(pool)), (None, None), (8, None), (9, ""), rows[3], rows[3]]


@pytest.mark.parametrize("star", [256, 8])
def test_lines_match_all_pairs(spark, monkeypatch, star):
    monkeypatch.setattr(linededup, "STAR", star)
    rows = rows_of(star)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, removed_by string, n int").repartition(4)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.removed) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert got == brute(rows, linededup.MIN_WORDS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(docs).count() == 0


def test_words_of_one_key_in_a_line(spark):
    words = [f"w{i}" for i in range(200_000)]
    c = next(linededup.chunks(linededup.pa.array([" ".join(words)])))
    rank = (np.uint64(25) << np.uint64(54)) | (c.hashes() >> np.uint64(10))
    key = linededup.word_ranks(c.hashes(), np.zeros(linededup.BUCKETS, np.uint8)).astype(np.uint32)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    assert len(at)
    common = [f"common{i}" for i in range(7)]
    rows = [(i, " ".join([words[order[k]], words[order[k + 1]], *common])) for i, k in enumerate(at[:3])]
    rows += [(100 + i, f"{w} alone here{i}") for i, w in enumerate(common * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = spark.sparkContext.broadcast(linededup.rarity(docs))
    lines = linededup._lines(docs.selectExpr("doc_id d", "doc_id rk", "text"), held, 5, 8).collect()
    keys = [np.frombuffer(r["keys"], np.int32) for r in lines]
    assert any(len(set(k)) < len(k) for k in keys[:3])
    got = sorted(((r.doc_id, r.text, r.n_lines, r.removed) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert got == brute(rows, linededup.MIN_WORDS)


@pytest.mark.parametrize("tenths", [8, 6, 10])
def test_short_lines(spark, tenths):
    rng = random.Random(tenths)
    words = [f"s{i}" for i in range(9)]
    lines = ["All rights reserved.", "Les.", "les. Les.", "of of of of of of", " \t", "", "a b c d", "a b c d e", "b c d e", "d c b a"]
    lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 3)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.removed) for r in linededup.dedup_lines(docs, tenths / 10).collect()), key=str)
    assert got == brute(rows, 1, tenths)


def alike_rows():
    rng = random.Random(5)
    words = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(3000):  # one template: each line has two to four words of its own, and few lines are similar to the first
        own = list(words)
        for k in rng.sample(range(40), rng.choice([2, 3, 4, 4, 4])):
            own[k] = f"o{i}x{k}" if rng.random() < 0.5 else f"o{i // 100}x{k}"
        rows.append((i, " ".join(own)))
    return rows + [(5000 + i, " ".join([*words[:20], *(f"z{i}y{k}" for k in range(20))])) for i in range(50)]


@pytest.mark.parametrize("star", [4096, 50])
def test_many_alike_lines(spark, monkeypatch, star):
    monkeypatch.setattr(linededup, "STAR", star)
    monkeypatch.setattr(linededup, "_POSTINGS", 20_000)
    rows = alike_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.removed for r in linededup.dedup_lines(docs).collect()}
    sets = [set(t.split()) for _, t in rows]
    size = np.array([len(w) for w in sets])
    held = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
    grid = np.zeros((len(sets), len(held)), np.float32)
    for i, w in enumerate(sets):
        grid[i, [held[x] for x in w]] = 1
    both = grid @ grid.T
    near = np.tril(10 * both >= 8 * (size[:, None] + size - both), -1).any(1)
    assert got == {d: [0] if near[i] else None for i, (d, _) in enumerate(rows)}
    assert 0 < near.sum() < len(rows)


def test_columns_of_the_same_names_and_a_very_long_text(spark):
    long = "\n".join(" ".join(f"q{i}{j}" for j in range(9)) for i in range(30_000)) + "\n" + " ".join(f"w{j}" for j in range(50_000))
    rows = [(1, long, "x", [1]), (2, long.split("\n")[7] + "\nnew", "y", None), (3, long.split("\n")[-1], "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, removed array<int>")
    found = linededup.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "n_lines", "removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.removed) for r in found.collect()}
    assert got == {1: (long, 30_001, None), 2: ("new", 2, [0]), 3: ("", 1, [0])}


def test_filters_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FILTER", 1 << 10)
    x = np.arange(5000) * 7919 - 10**7
    frame = spark.createDataFrame([(int(v),) for v in x], "k long").repartition(3)
    bits = linededup._bits(frame, "k")
    assert np.bitwise_count(bits).sum() * 8 < 8 * len(bits)
    assert linededup._within(bits, x).all() and linededup._within(bits, np.arange(10**6)).mean() < 0.125
    assert not linededup._bits(frame.limit(0), "k").any()


def test_a_long_list_of_few_pairs_leaves_no_line(monkeypatch):
    monkeypatch.setattr(linededup, "STAR", 64)
    n = 8 * 2 ** np.arange(10)  # ten sizes, far apart
    size, at = np.repeat(n, 20), np.arange(200)
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 62, (2, 200))
    v = {"key": np.zeros(200, np.int32), "part": np.full(200, -1, np.int32), "id": at, "packed": (size << 32) | 3, "parity": bits[0], "parity2": bits[1]}
    batch = linededup.pa.RecordBatch.from_arrays([linededup.pa.array([x.astype(linededup.POSTING[k]).tobytes()], linededup.pa.binary()) for k, x in v.items()], list(v))
    rows = [r for out in linededup._candidates(8)(iter([batch])) for r in out.to_pylist()]
    assert rows and not [r for r in rows if r["a"] is None]
