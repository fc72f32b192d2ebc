import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotewell.llm import mixing
from quotewell.llm.common import Scratch, rank_within

SCHEMA = "doc_id long, text string, source string, size int, n string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return {s: t.get(s, most * sizes[s]) for s in order}
        capped |= over


def brute_rates(sizes, target, most=3):
    """Bisection on the multiplier."""
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        got = sum(c * min(most, math.exp(min(50, mid * c / 100))) for c in sizes)
        low, high = (mid, high) if got < target else (low, mid)
    return {c: min(most, math.exp(min(50, mid * c / 100))) for c in sizes}


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_rates_and_copies(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["a", "b", "é", "Z", None, "tiny"])
        n = 3 if source == "tiny" else rng.choice([0, 1, 5, 40, 40, 40, 170, rng.randint(1, 400)])
        rows.append((i, None if n == 0 and i % 2 else " ".join(["w"] * n), source, 1, ""))
    rows += [(5, "same id again", "a", 1, ""), (None, "no id", "b", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, ["doc_id", "source", "text"]).collect()
    assert len(got) == len(rows)
    sizes, members = defaultdict(int), defaultdict(list)
    for _, t, s, *_ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        members[s].append(n)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.copies <= 3
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.copies * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.002 * t), (s, taken[s], t)
    # documents of a size in a source get the rate of the dual, up to one copy by rounding and the added single copies
    copies = defaultdict(list)
    for r in got:
        copies[r.source, r["size"]].append(r.copies)
    for s in want:
        if 0 < want[s] < 3 * sizes[s] * (1 - 1e-9):
            rates = brute_rates([c for c in members[s] if c], want[s])
            for c, rate in rates.items():
                own = copies[s, c]
                assert max(own) - min(own) <= 1
                assert abs(sum(own) - rate * len(own)) <= 2 + mixing.ROUNDS, (s, c)
    again = mixing.mix(docs.repartition(3), ["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a", 1, ""), (2, " ", None, 1, "")], SCHEMA), ["doc_id"]).collect()
    assert [r.copies for r in got] == [0, 0]


def test_rank_within_is_gapless_and_ignores_parts(spark):
    rows = [(i, "hot" if i % 3 else None, i % 7) for i in range(3000)]
    df = Scratch(spark, "t").save(spark.createDataFrame(rows, "id long, k string, z long"), "r")
    got = rank_within(df, ["k"], ["id"]).collect()
    for k in ("hot", None):
        own = sorted((r.rank, r.id) for r in got if r.k == k)
        assert [r for r, _ in own] == list(range(len(own)))
    plain = df.where("k is null").withColumn("h", F.xxhash64("id")).orderBy("h").select("id").collect()
    assert [r.id for r in plain] == [i for _, i in sorted((r.rank, r.id) for r in got if r.k is None)]


def test_plans_run_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
