import base64
import hashlib
import random
from collections import defaultdict

from quotewell.llm import warc
from quotewell.llm.common import Scratch


def test_loser_tree_merges_like_sorted():
    rng = random.Random(4)
    for _ in range(300):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def expected(rows):
    by = defaultdict(list)
    for p, _, h in rows:
        by[h or ""].append(p)
    out = []
    for p, _, h in rows:
        same = [x for x in by[h or ""] if x is not None]
        first = min(same) if same else None
        refers = first if len(by[h or ""]) > 1 and p != first else None
        data = (h or "").encode()
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_archives_round_trip_and_index_is_in_order(spark):
    rng = random.Random(6)
    rows = [(i, f"http://{rng.choice('abc')}.example.com/{rng.randint(0, 5)}", rng.choice(["<p>é\r\n\r\nx</p>", "", None, "y" * rng.randint(1, 9000)])) for i in range(400)] + [(None, None, "alone"), (None, "not a url", ""), (5, "http://[bad", "twice"), (5, "http://[bad", "twice")]
    pages = spark.createDataFrame([(*r, "other", 1) for r in rows], "page_id long, url string, html string, payload_digest string, n int").repartition(7)
    got = warc.write_and_read(pages).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    assert all(r.html == ("" if dict((p, h) for p, _, h in rows)[r.page_id] is None else r.html) for r in got if r.record_type == "response")
    scratch = Scratch(spark, "t")
    runs = scratch.save(warc.write_archives(pages.selectExpr("page_id", "url", "html", "cast(null as long) refers_to"), f"{scratch.root}/a"), "runs")
    for fan_in in (2, 64):
        index = warc.read_index(warc.merge_runs(runs, scratch, fan_in)).orderBy("part", "pos").collect()
        keys = [(r.url_key, r.timestamp, r.page_id) for r in index]
        assert keys == sorted(keys) and len(keys) == len(rows)
    assert warc.write_and_read(pages.limit(0)).count() == 0


def test_captures_alike_in_url_time_and_page_are_cut_apart(spark, monkeypatch):
    monkeypatch.setattr(warc, "_BLOCK", 4)
    pages = spark.range(300).selectExpr("cast(null as long) page_id", "'http://a.example.com/' url", "concat('p', id % 3) html", "cast(null as long) refers_to").repartition(5)
    scratch = Scratch(spark, "t")
    runs = scratch.save(warc.write_archives(pages, f"{scratch.root}/a"), "runs")
    for sample in (40, 20_000):
        monkeypatch.setattr(warc, "SAMPLE", sample)
        segments = warc.merge_runs(runs, scratch, 2)
        assert sorted(r.n for r in segments.collect())[-1] < 150
        index = warc.read_index(segments).orderBy("part", "pos").collect()
        places = [(r.archive, r.offset) for r in index]
        assert places == sorted(set(places)) and len(places) == 300
        assert warc.read_archives(warc.read_index(segments)).count() == 300
