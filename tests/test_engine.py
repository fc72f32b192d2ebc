import gzip
import io
import random
import tarfile
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quotewell.functions import exact
from quotewell.functions import scalars as X
from quotewell.operators import asof, book, datasets, merge, reconcile
from quotewell.plans.paths import TooManyPaths, graph, paths
from quotewell.sources import publish, readers
from quotewell.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("7.98e-05", "0.0000798"), ("1e-29", None), ("1.5", "1.5"), ("-2E3", "-2000"), ("x", None), ("0.1234567890123456789", None), ("1.000000000000000000000", "1"), ("", None), ("1e20", None)])
def test_exact_decimals(spark, text, want):
    got = one(spark, X.parse_decimal(F.lit(text)))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "unit", "want"), [("1730125800510827641", "ns", 1730125800510827641), ("1.0000000001", "s", None), ("1.5", "s", 1_500_000_000), ("-1.25", "s", -1_250_000_000), ("12", "ms", 12_000_000), ("9999999999999999", "s", None), ("1.5", "ms", None)])
def test_epoch_texts(spark, text, unit, want):
    assert one(spark, X.to_ns(F.lit(text), unit)) == want


def test_iso_times_and_windows(spark):
    assert one(spark, X.iso_to_ns(F.lit("2024-10-28T14:30:00.510827641Z"))) == 1730125800510827641
    assert one(spark, X.iso_to_ns(F.lit("2024-10-28T14:30:60Z"))) is None
    assert one(spark, X.iso_to_ns(F.lit("2024-10-28 14:30:00Z"))) is None
    assert one(spark, X.ns_to_utc(F.lit(1730125800510827641))) == "2024-10-28T14:30:00.510827641Z"
    assert one(spark, X.ns_to_utc(F.lit(-1))) == "1969-12-31T23:59:59.999999999Z"
    assert one(spark, X.window_start(F.lit(-1))) == -3_600_000_000_000


def test_quantities(spark):
    d = lambda x: F.lit(x).cast("decimal(18,4)")
    cases = [("base", "2.5", "85000", None, False, (2.5, 212500, None)), ("quote", "170000", "85000", None, False, (2, 170000, None)), ("contracts", "10", "85000", "0.01", False, (0.1, 8500, 10)), ("contracts", "100", "50000", "100", True, (0.2, 10000, 100))]
    for kind, q, p, v, inverse, want in cases:
        got = X.normalize_quantity(kind, d(q), d(p), None if v is None else d(v), inverse)
        assert tuple(None if x is None else float(x) for x in (one(spark, got[f"quantity_{k}"]) for k in ("base", "quote", "contracts"))) == want


def test_id_order_and_levels(spark):
    ids = ["10", "9", "0100", "abc", "99999999999999999999999"]
    got = [r.x for r in spark.createDataFrame([(i,) for i in ids], "x string").orderBy(X.native_id_order(F.col("x"))).collect()]
    assert got == ["9", "10", "0100", "99999999999999999999999", "abc"]
    assert [tuple(map(float, r)) for r in one(spark, X.level_array(F.lit('[["1.5","2"],["3","0",7]]')))] == [(1.5, 2), (3, 0)]
    assert [tuple(map(float, r)) for r in one(spark, X.level_array(F.lit('[{"p":"1","q":"2"}]'), ("p", "q")))] == [(1, 2)]


def test_exact_ratios_round_half_even_once(spark):
    half = "0." + "0" * 27 + "1"
    row = spark.range(1).select(exact.divide(F.lit("1"), F.lit("3")).alias("third"), exact.multiply(F.lit(half), F.lit("0.5")).alias("down"), exact.multiply(F.lit("0." + "0" * 27 + "3"), F.lit("0.5")).alias("up"), exact.divide(F.lit("1"), F.lit("0")).alias("zero"), exact.multiply_ratio(F.lit("2"), F.lit("1"), F.lit("3")).alias("ratio"), exact.multiply(F.lit("1e50"), F.lit("1e20")).alias("over")).first()
    assert tuple(row) == ("0." + "3" * 28, "0", "0." + "0" * 27 + "2", None, "0." + "6" * 27 + "7", None)


def test_causal_order_is_the_heads_in_turn(spark):
    rng = random.Random(2)
    rows = [(s, o, rng.randint(0, 30)) for s in range(3) for o in range(40)]
    heads, want = {s: [(t, o) for x, o, t in rows if x == s] for s in range(3)}, []
    while any(heads.values()):
        s = min((s for s in heads if heads[s]), key=lambda s: (heads[s][0][0], s))
        t, o = heads[s].pop(0)
        want.append((s, o))
    df = spark.createDataFrame([(t, s, 0, o) for s, o, t in rows], "event_timestamp_ns long, stream_rank long, task_rank long, event_ordinal long")
    assert [(r.stream_rank, r.event_ordinal) for r in merge.causal(df.repartition(5)).collect()] == want
    with pytest.raises(ValueError, match="regresses"):
        merge.chronological(df)


def test_highest_times_are_carried_over_buckets_and_tasks(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 60) if rng.random() < 0.9 else None, s, t, o) for s in range(3) for t in range(3) for o in range(17)]
    df = spark.createDataFrame(rows, "event_timestamp_ns long, stream_rank long, task_rank long, event_ordinal long").repartition(6)
    top, late, high = {}, [], []
    for time, s, t, o in rows:
        if time is not None and s in top and time < top[s]:
            late.append((time, s, t, o))
        if time is not None:
            top[s] = max(top.get(s, time), time)
        high.append((s, t, o, top.get(s)))
    for bucket in (1, 4, 1 << 20):
        assert sorted(tuple(r) for r in merge.regressions(df, bucket).collect()) == sorted(late)
        assert sorted(tuple(r) for r in merge.causal_key(df, bucket).select("stream_rank", "task_rank", "event_ordinal", "merge_time").collect()) == high
        kept = merge.chronological(df.where("event_timestamp_ns is not null"), "drop", bucket).count()
        assert kept == sum(r[0] is not None for r in rows) - len(late)


def test_strict_asof_matches_brute_force_on_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), i, rng.choice("ABE"), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts long, ord long, stream string, price double").repartition(4)
    for width in (7, 1000):
        for by_time in (False, True):
            got = asof.strict_asof(df, {"a": F.col("stream") == "A", "b": F.col("stream") == "B"}, "price", ["ts", "ord"], width, by_time).collect()
            for r in got:
                for name, s in (("a", "A"), ("b", "B")):
                    best = max(((t, o) for t, o, x, _ in rows if x == s and ((t < r.ts) if by_time else (t, o) < (r.ts, r.ord))), default=None)
                    assert (None if r[name] is None else (r[name].ts, r[name].ord)) == best


def test_currency_paths():
    g = graph([("s1", "BTC", "USDT"), ("s2", "ETH", "BTC"), ("s3", "ETH", "USDT")])
    found = paths(g, "ETH", "USDT")
    assert [[e.stream_id for e in p] for p in found] == [["s2", "s1"], ["s3"]]  # depth first: BTC sorts before USDT
    with pytest.raises(TooManyPaths):
        paths(g, "ETH", "USDT", limit=1)
    assert paths(g, "XRP", "USDT") == [] and paths(g, "BTC", "BTC") == [()]
    assert [[e.inverse for e in p] for p in paths(g, "USDT", "ETH")] == [[True, True], [True]]


def test_book_continuity(spark):
    rows = [(1, 1, 5, 5, True), (1, 2, 6, 8, False), (1, 3, 10, 11, False), (1, 4, 12, 12, False), (1, 5, 20, 20, True), (1, 6, 21, 21, False), (2, 1, 1, 1, False)]
    df = spark.createDataFrame(rows, "s long, ordinal long, sequence_start long, sequence_end long, is_init boolean")
    got = {(r.s, r.ordinal): r.continuity for r in book.continuity(df, ["s"]).collect()}
    assert [got[1, i] for i in range(1, 7)] == ["accepted", "accepted", "gap", "missing_snapshot", "accepted", "accepted"] and got[2, 1] == "missing_snapshot"


def test_conflicts_fail_a_strict_run(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, 1.0), (2, 1, 2.0)], "id long, source long, price double")
    r = reconcile.reconcile_trades(rows, ["id"], ["source"], ["price"])
    with pytest.raises(reconcile.IdentityConflict):
        reconcile.winners(r)
    assert reconcile.winners(r, strict=False).count() == 2


def test_archives_and_commits(spark, tmp_path):
    body = b"1,2.5,B\n2,3.5,S\n"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(body) + gzip.compress(b"3,4,B\n"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.csv", body)
        z.writestr("two.txt", b"no")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in.csv")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    lines = readers.read_members(spark, str(tmp_path), r"\.csv$")
    assert lines.count() == 7
    rows = readers.split_lines(lines, ["ts", "price", "side"])
    assert {(r.ts, r.price, r.side) for r in rows.collect()} == {("1", "2.5", "B"), ("2", "3.5", "S"), ("3", "4", "B")}
    out = f"{tmp_path}/published"
    manifest = publish.publish(rows, out, ["ts"])
    assert manifest["rows"] == 7 and publish.read_manifest(spark, out) == manifest
    with pytest.raises(FileExistsError):
        publish.publish(rows, out, ["ts"])
    assert readers.read_canonical(spark, out).count() == 7


def test_head_batches_and_comparison(spark):
    df = spark.range(100).selectExpr("id event_timestamp_ns", "'s' stream_id", "id trade_id")
    s = datasets.Stream(df)
    assert [r.trade_id for r in s.head(3, start=5).collect()] == [5, 6, 7]
    assert sum(t.num_rows for t in s.batches(start=10, end=30)) == 20
    assert datasets.comparable(df, df.select("trade_id", "stream_id", "event_timestamp_ns"))


def test_event_time_merge_waits_for_every_input_and_fails_on_late_data():
    m = live.OrderedMerge(["a", "b"], lateness=5)
    m.add("a", None, 0, "base")
    m.add("a", 10, 1, "x")
    m.add("a", 20, 2, "y")
    assert m.ready() == []
    m.add("b", 16, 3, "z")
    assert [p for _, _, _, p in m.ready()] == ["base", "x"]
    m.add("b", 40, 4, "w")
    m = live.OrderedMerge.load(["a", "b"], 5, 10, m.dump())
    with pytest.raises(live.StreamFailure):
        m.add("b", 30, 5, "late")
    assert [p for _, _, _, p in m.finish()] == ["z", "y", "w"]


def test_live_state_machines():
    ids = live.RecentIds(3)
    assert ids.admit(["1", "2", "1"]) == [True, True, False]
    assert ids.admit(["3", "4"]) == [True, True] and ids.admit(["1"]) == [True]
    gaps = live.TradeGaps()
    assert [gaps.add(i) for i in (5, 6, 6, 9, 7)] == ["contiguous", "contiguous", "duplicate", "gap", "regression"]
    depth = live.DepthContinuity()
    assert depth.delta(8, 9) == "buffered" and depth.delta(10, 12) == "buffered"
    assert depth.snapshot(10) == [(10, 12)]
    assert [depth.delta(*x) for x in ((5, 12), (13, 14), (17, 18))] == ["stale", "applied", "gap"]


def test_streaming_merge_query(spark, tmp_path):
    rows = [("m", 10, "a", 1, "x", False), ("m", 7, "b", 2, "y", False), ("m", 30, "a", 3, "z", False), ("m", None, "a", 9, "", True)]
    schema = "merge_id string, ts long, source string, ordinal long, payload string, is_end boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = live.merge_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["a", "b"], 5)
    q = out.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.payload for r in spark.table("merged").orderBy("position").collect()] == ["y", "x", "z"]


def test_entry_works_without_the_training_data_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "quotewell", tmp_path / "quotewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(said.stdout) > 40, said.stderr
