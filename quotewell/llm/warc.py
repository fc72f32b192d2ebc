"""WARC archives of pages with revisit records, and an external merge of their capture indexes.

Writers put a gzip member per record into an archive of their own and sort what they wrote by (URL key, timestamp) into a
run. Runs are merged k ways by a loser tree, at most ``fan_in`` at a time, in ranges of the key space that are cut at
sampled keys, until each range is one segment: the segments in order are the capture histories of all URLs. Reading goes
through that index: its entries, dealt back to their archives in offset order, say where each record lies.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, partitions
from .files import open_fs

#: Lines of a run between two entries of its block index.
_BLOCK = 256
#: Block keys that cut the key space into ranges.
SAMPLE = 20_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest, lower-cased; what can't be split stays as it is, null is empty."""
    try:
        parts = urlsplit((url or "").strip().lower())
    except ValueError:
        return (url or "").lower()
    host = (parts.netloc.rpartition("@")[2]).split(":")[0]
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else (url or "").lower()


class LoserTree:
    """Merges sorted iterators: the root knows the winner, inner nodes the losers, so a step compares once a level."""

    def __init__(self, sources: list[Iterable]):
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, None) for s in self.sources]
        n = self.n = max(1, len(sources))
        self.tree = [-1] * n
        for i in range(len(sources)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        at = (i + self.n) // 2
        while at:
            if self.tree[at] == -1:
                self.tree[at] = i
                return
            if self._less(self.tree[at], i):
                self.tree[at], i = i, self.tree[at]
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.sources and (w := self.tree[0]) != -1 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def decide(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to) of each page; null html is an empty payload.

    Of equal payloads of ``least_bytes`` or more, the smallest page_id is the response and the others, null page_ids too,
    refer to it. Rows that repeat the smallest page_id are responses as well.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digests = scratch.save(pages.select(F.col("page_id").cast("long"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "utf-8")).alias("sha")), "digests")
    first = digests.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    return lookup_join(digests, first, ["sha"]).select("page_id", "payload_bytes", "sha", refers)


def _record(row: dict) -> bytes:
    when = row.get("captured_at") or EPOCH + timedelta(seconds=(row["page_id"] or 0) % 10**9)
    payload = (row["html"] or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "revisit" if row["refers_to"] is not None else "response"
    url = "".join(c if c > " " else "%20" for c in row["url"] or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row['page_id']} {url}')}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if row['page_id'] is None else row['page_id']}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """What a record says; the size and digest of a response are taken from its payload itself."""
    head, _, rest = record.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if said["WARC-Type"] == "revisit":
        size, digest = int(http.rpartition(b"Content-Length: ")[2]), said["WARC-Payload-Digest"].removeprefix("sha1:")
    elif f"sha1:{digest}" != said["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of page {said['X-Page-Id']} doesn't match its digest")
    refers = said.get("WARC-Refers-To", "").removeprefix("<urn:page:").rstrip(">")
    page = said["X-Page-Id"].strip()
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": said["WARC-Type"], "refers_to": int(refers) if refers else None, "html": payload.decode() if said["WARC-Type"] == "response" else None, "url": said["WARC-Target-URI"], "date": said["WARC-Date"]}


def write_archives(pages: DataFrame, root: str, level: int = 1) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as they are dealt; a row for each sorted run: its file, size and block index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
        fs, path = open_fs(file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        entries, at = [], 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {n: batch[n][k].as_py() for n in batch.schema.names}
                    member = gzip.compress(_record(row), level, mtime=0)
                    when = row.get("captured_at") or EPOCH + timedelta(seconds=(row["page_id"] or 0) % 10**9)
                    entries.append((url_key(row["url"]), f"{when:%Y%m%d%H%M%S}", -1 if row["page_id"] is None else row["page_id"], file, at, len(member)))
                    out.write(member)
                    at += len(member)
        if not entries:
            fs.delete_file(path)
            return
        entries.sort()
        yield _run_row(root, entries)

    return pages.mapInArrow(run, RUN)


RUN = "file string, n long, keys array<string>, offsets array<long>"


def _run_row(root: str, entries: Iterable[tuple], name: str = "run") -> pa.RecordBatch:
    """Writes sorted entries as lines of JSON with a block index."""
    file = f"{root}/{name}-{uuid.uuid4().hex}.cdxj"
    fs, path = open_fs(file)
    keys, offsets, n, at = [], [], 0, 0
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for e in entries:
            line = json.dumps(e, ensure_ascii=False).encode() + b"\n"
            if n % _BLOCK == 0:
                keys.append(json.dumps(e[:5], ensure_ascii=False))
                offsets.append(at)
            out.write(line)
            n, at = n + 1, at + len(line)
    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pylist([{"file": file, "n": n, "keys": keys, "offsets": [*offsets, at]}], schema)


def _lines(file: str, start: int, size: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run from ``start`` on with low <= key < high, a few blocks in memory at a time."""
    fs, path = open_fs(file)
    with fs.open_input_file(path) as f:
        at, rest = start, b""
        while at < start + size:
            data = rest + f.read_at(min(1 << 18, start + size - at), at)
            at = min(at + (1 << 18), start + size)
            lines = data.split(b"\n")
            rest = lines.pop()
            for line in lines:
                e = tuple(json.loads(line))
                if high is not None and e[:5] >= high:
                    return
                if low is None or e[:5] >= low:
                    yield e


def merge_runs(runs: DataFrame, scratch: Scratch, fan_in: int = 64) -> DataFrame:
    """(part, file, n): the segments of the global order, one a key range.

    The driver holds about ``SAMPLE`` block keys, which only cut the ranges. A key ends in its record's place, so it is unique and
    captures that agree in URL, time and page are cut apart like all others. Which blocks of which run a range takes is
    worked out where the runs are, and a merge takes at most ``fan_in`` of them.
    """
    spark = runs.sparkSession
    blocks = runs.agg(F.sum(F.size("keys"))).first()[0] or 0
    lot = F.xxhash64("file", "pos") / F.lit(2.0**64) + F.lit(0.5)
    drawn = runs.select("file", F.posexplode("keys").alias("pos", "key")).where(lot < SAMPLE / max(blocks, 1)).select("key").collect()
    sample = sorted(tuple(json.loads(r["key"])) for r in drawn)
    wanted = min(partitions(spark), max(1, len(sample)))
    cuts: list[tuple | None] = [None, *sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)})] if sample else [None]
    held = spark.sparkContext.broadcast(list(zip(cuts, [*cuts[1:], None], strict=True)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, offsets, out = [tuple(json.loads(k)) for k in row["keys"]], row["offsets"], []
                for i, (low, high) in enumerate(held.value):
                    a = 0 if low is None else max(0, bisect.bisect_left(keys, low) - 1)
                    b = len(keys) if high is None else bisect.bisect_left(keys, high)
                    if b > a:
                        out.append({"part": i, "file": row["file"], "start": offsets[a], "size": offsets[b] - offsets[a]})
                yield pa.RecordBatch.from_pylist(out, SOURCE_ARROW)

    sources, ranges = scratch.save(runs.select("file", "keys", "offsets").mapInArrow(place, "part int, file string, start long, size long"), "sources"), held
    while True:
        rank = F.row_number().over(Window.partitionBy("part").orderBy("file")) - 1
        jobs = sources.withColumn("job", F.floor(rank / fan_in)).groupBy("part", "job").agg(F.collect_list(F.struct("file", "start", "size")).alias("sources"))
        jobs = scratch.save(jobs, "jobs")
        n = max(1, min(jobs.count(), 4 * partitions(spark)))
        merged = scratch.save(jobs.repartition(n, "part", "job").mapInArrow(_merge(f"{scratch.root}/merged", ranges), "part int, job long, file string, n long, size long"), "segments")
        if not merged.agg(F.max("job")).first()[0]:
            return merged.select("part", "file", "n")
        sources, ranges = merged.select("part", "file", F.lit(0).cast("long").alias("start"), "size"), None


def _merge(root: str, ranges: Broadcast | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = ranges.value[row["part"]] if ranges else (None, None)
                done = _run_row(root, LoserTree([_lines(s["file"], s["start"], s["size"], low, high) for s in row["sources"]]), "segment").to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "job": row["job"], "file": done["file"], "n": done["n"], "size": done["offsets"][-1]}], SEGMENT_ARROW)

    return run


SOURCE_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("job", pa.int64()), ("file", pa.string()), ("n", pa.int64()), ("size", pa.int64())])


def read_index(segments: DataFrame) -> DataFrame:
    """(part, pos, url_key, timestamp, page_id, archive, offset, size): the captures, ordered by (part, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["file"])
                size, rows = fs.get_file_info(path).size, []
                for pos, e in enumerate(_lines(row["file"], 0, size, None, None)):
                    rows.append({"part": row["part"], "pos": pos, "url_key": e[0], "timestamp": e[1], "page_id": e[2], "archive": e[3], "offset": e[4], "size": e[5]})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)

    return segments.mapInArrow(run, "part int, pos long, url_key string, timestamp string, page_id long, archive string, offset long, size long")


INDEX_ARROW = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()), ("url", pa.string()), ("date", pa.string()), ("url_key", pa.string())])


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, each read once, archive by archive in ascending offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, size, key in zip(batch["archive"].to_pylist(), batch["offset"].to_pylist(), batch["size"].to_pylist(), batch["url_key"].to_pylist(), strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    fs, path = open_fs(archive)
                    name, f = archive, fs.open_input_file(path)
                rows.append(parse(zlib.decompress(f.read_at(size, offset), 31)) | {"url_key": key})
                held += len(rows[-1]["html"] or "")
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    spark = index.sparkSession
    # blocks of an archive go to tasks of their own, so that neither archives nor tasks need be alike in size
    dealt = index.repartition(partitions(spark), "archive", F.expr("offset div (4 << 20)")).sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "size", "url_key").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, url string, date string, url_key string")


def write_and_read(pages: DataFrame, least_bytes: int = 0, fan_in: int = 64) -> DataFrame:
    """Archives ``pages`` and reads them back through the merged index."""
    scratch = Scratch(pages.sparkSession, "warc")
    decided = scratch.save(decide(pages, scratch, least_bytes), "decided")
    # (nameless, p, s) is never null, so rows without a page_id are dealt out as a hot key like any other
    key = ["nameless", "p", "s"]
    named = [F.col("page_id").isNull().alias("nameless"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("p")]
    revisits = decided.where("refers_to is not null").select(*named, F.col("sha").alias("s"), "refers_to").distinct()
    counts = decided.groupBy(*named, F.col("sha").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    html = F.coalesce(F.col("html"), F.lit(""))
    when = [F.col("captured_at")] if "captured_at" in pages.columns else []
    own = pages.select(F.col("page_id").cast("long"), "url", "html", *when, *named, F.sha1(F.encode(html, "utf-8")).alias("s"))
    joined = lookup_join(own, revisits, key, "left", counts).select("page_id", "url", "html", "refers_to", *when)
    runs = scratch.save(write_archives(joined, f"{scratch.root}/archives"), "runs")
    return read_archives(read_index(merge_runs(runs, scratch, fan_in)))
