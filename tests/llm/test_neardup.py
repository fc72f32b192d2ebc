import random
import re

import numpy as np

from quotewell.llm import neardup


def sets_of(texts, k):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    return out


def brute(rows, k, percent=80):
    """Component ids of (doc_id, text) rows, by all pairs."""
    sets = sets_of([t for _, t in rows], k)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed, n_words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c d", "a b c d e"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, n_words, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            base = own if rng.random() < 0.5 else base  # chains: ends of a component need not be similar
            texts.append(rng.choice([" ", "\n"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    texts += ["common passage of the many copies here " * 3 + f"tail {i}" for i in range(40)]
    texts += ["one and the same text for a third of all rows"] * 80
    rng.shuffle(texts)
    return [(i + 1000, t) for i, t in enumerate(texts)] + [(1003, "row of the same id"), (None, "no id but words"), (None, None)]


def test_components_match_all_pairs(spark):
    for seed, k in ((1, 4), (2, 5)):
        rows = near_rows(seed)
        docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, n int, fp string").repartition(5)
        got = sorted((tuple(r) for r in neardup.near_duplicates(docs, k=k).collect()), key=str)
        assert got == brute(rows, k)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[400:2400]
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(x[:2400])).all()
    errors = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 2400, dtype=np.uint64)
        ra, rb = neardup.registers(x[:2000]), neardup.registers(x[400:])
        errors.append(neardup.likely_similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2000.0]), np.array([2000.0]))[0] - 1600 / 2400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def nameless_rows():
    rng = random.Random(11)
    fresh = lambda: [f"v{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda words, at: " ".join([*words[:at], f"x{at}", *words[at + 1 :]])
    a, b, c, d = (fresh() for _ in range(4))
    bridge = [" ".join(x) for x in (b, [*b[4:], *"klmn"], [*b[8:], *"klmnopqr"])]  # the middle one is near to both ends
    rows = [(None, near(a, 5)), (None, near(a, 58)), (None, " ".join(a))]
    rows += [(1, bridge[0]), (None, bridge[1]), (2, bridge[2])]
    rows += [(None, " ".join(c))] * 3 + [(3, near(d, 1)), (3, near(d, 58)), (4, " ".join(d)), (4, " ".join(fresh())), (5, " ".join(c)), (None, near(c, 59))]
    return rows + [(None, " ".join(fresh())), (6, "alone with these few words"), (6, "alone with these few words")]


def test_near_copies_without_an_id(spark):
    rows = nameless_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 4)
    got = neardup.near_duplicates(docs, k=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted((x[:3] for x in want), key=str)
    # groups: a, bridge, c, d, three that are alone (one of them is a row that is there twice)
    assert sum(r.kept for r in got) == 8
    assert {(r.doc_id, r.component_id) for r in got if r.kept} == {(None, None), (1, 1), (3, 3), (4, 4), (5, 5), (6, 6)}


def test_stage_keeps_one_document_a_group(spark):
    import corpus_pipeline as cp

    rows = nameless_rows()
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in cp.near_dedup(spark, docs, "").collect())
    assert got == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
