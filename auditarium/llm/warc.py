"""Web archives: pages as WARC records, and their capture histories by an external merge of index runs.

Writing: each task writes archives (one gzip member a record, so that a record can be read by its offset) and, while it does, collects index entries. After `run_entries` of
them, and at its end, it sorts what it has and writes it as a run: an Arrow file of blocks of `BLOCK` entries. Names are unique for each attempt, and only runs
and archives that committed tasks have listed are read, so lost or repeated tasks leave no records. What `LISTS` tasks list goes into one file, not a file of a row from each;
it is dealt by the task's number, so that a repeated task, whose names differ, takes the place of its whole list.

Of pages with equal payloads the one with the largest page_id is a response, the others revisit it: they name it and have the digest and the length of the payload, but not
the payload. Who is the response comes from one aggregate by the payload's SHA-256 (combined before the shuffle) that is joined back, one row a key, so a payload
of a third of all pages is split by adaptive execution. Payloads travel once.

Merging: while there are more than `fan` runs, groups of about `fan` become one each, a task a group. The last `fan` or fewer are cut by key ranges, from marks
that each run gives along with itself (a bounded sample that only balances), and a task merges each range. All merging is k-way by a loser tree over
streams of blocks, so a task holds one block of each run. Ranges in order give all captures in order of URL key (host reversed), time, id: `merged` numbers
them by range and place. A URL of a third of all pages is cut by time.

Reading: `read_records` takes captures in their order, some thousand at a time, and reads these by archive and offset.

Nulls: a null html is an empty payload, a null url an empty target, a null time 1970, a null page_id stays null (such pages revisit others of their payload; if all have
null ids, all are responses). Pages that share the largest page_id of their payload (repeated rows) are each a response. A very long page is one record, held by one task. Control characters and spaces of a
URL are percent-encoded. An empty table gives no records. Other columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table, written

ARCHIVE_BYTES, RUN_ENTRIES, FAN, BLOCK, RANGE, LEVEL = 256 << 20, 1 << 16, 64, 512, 1 << 13, 4
#: Tasks whose lists of runs share a file.
LISTS = 64
#: Marks that a run gives for cutting, and their length.
MARKS, MARK_BYTES = 512, 200
#: Captures that are read from archives at once, and bytes of them.
READ_ROWS, READ_BYTES = 2048, 16 << 20
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = [("url_key", pa.binary()), ("captured", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]
ENTRY = pa.schema(_ENTRY)
_ENTRY_SQL = "url_key binary, captured long, page_id long, archive string, offset long, size long"
_RUN_SQL = "path string, entries long, marks array<struct<url_key:binary,captured:long>>"
_RUN = pa.schema([("path", pa.string()), ("entries", pa.int64()), ("marks", pa.list_(pa.struct([("url_key", pa.binary()), ("captured", pa.int64())])))])


def _open(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def encoded_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str) -> bytes:
    """The host reversed and in lower case, without www, then port and path: example,org)/a?b. What has no host is a key as it is."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m or not m[1]:
        return url.encode()
    host = re.sub(r"^www\d*\.", "", m[1].lower()).strip(".").split(".")
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    return f"{','.join(reversed(host))}{port}){m[3] if m[3].startswith('/') else '/' + m[3]}".encode()


def stamp(micros: int | None) -> str:
    return datetime.fromtimestamp((micros or 0) / 1e6, UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, captured: int | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """A record's bytes, unpacked. refers_to: id, url and time of the response that a revisit names."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head.encode() + (b"" if refers_to else payload)
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", stamp(captured)), ("WARC-Target-URI", encoded_url(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-ID", "" if page_id is None else page_id)]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", encoded_url(refers_to[1])), ("WARC-Refers-To-Date", stamp(refers_to[2])), ("X-Refers-To-Page-ID", refers_to[0])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Fields of a record, the length that its HTTP head states, and the payload that it holds; ValueError on damage."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if lines[0] != "WARC/1.1" or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    return fields, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def gzipped(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


def _write_run(base: str, entries: list[tuple]) -> tuple:
    """A sorted run in a file of its own, and what is listed of it."""
    return _write_sorted(base, iter(sorted(entries, key=_order)), len(entries))


def _order(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


def _write_sorted(base: str, entries: Iterator[tuple], count: int) -> tuple:
    store, root = _open(base)
    name = f"{root}/{uuid.uuid4().hex}.run"
    step, marks, n = max(1, count // MARKS), [], 0
    with store.open_output_stream(name) as out, pa.ipc.new_file(out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        for block in _blocks(entries):
            marks += [{"url_key": e[0][:MARK_BYTES], "captured": e[1]} for e in block[-n % step :: step]]
            n += len(block)
            file.write_batch(_batch(block))
    return name, n, marks


def _blocks(entries: Iterator[tuple], size: int = BLOCK) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for e in entries:
        block.append(e)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def _batch(rows: list[tuple], schema: pa.Schema = ENTRY) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _archiver(path: str, archive_bytes: int, run_entries: int, level: int) -> Callable:
    """A task's part of the archives, and its runs as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)
        out, name, at, entries = None, "", 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "captured", "payload", "refers_to", "refers_url", "refers_captured")]
            for page_id, url, captured, payload, *refers in zip(*columns, strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(base, recursive=True)
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)  # else the name would make it pack twice
                page_id, url, captured, refers = page_id.as_py(), url.as_py(), captured.as_py() or 0, [r.as_py() for r in refers]
                data = gzipped(record(page_id, url, captured, payload.as_buffer().to_pybytes(), tuple(refers) if refers[0] is not None else None), level)
                out.write(data)
                entries.append((url_key(encoded_url(url)), captured, page_id, name, at, len(data)))
                at += len(data)
                if len(entries) >= run_entries:
                    yield _batch([_write_run(path, entries)], _RUN)
                    entries = []
        if out is not None:
            out.close()
        if entries:
            yield _batch([_write_run(path, entries)], _RUN)

    return run


def write_archives(pages: DataFrame, path: str, captured: Column | None = None, archive_bytes: int = ARCHIVE_BYTES, run_entries: int = RUN_ENTRIES, level: int = LEVEL) -> DataFrame:
    """Writes pages (page_id, url, html; captured: their times) as archives in the folder path. Returns its runs (path, entries, marks), a table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.unix_micros(captured if captured is not None else F.lit(None).cast("timestamp")).alias("captured"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    first = rows.groupBy("same").agg(F.max(F.struct("page_id", "url", "captured")).alias("first")).select(F.col("same").alias("other"), "first")
    joined = rows.join(first, rows["same"] == first["other"])
    other = F.col("first.page_id").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    refers = [F.when(other, F.col(f"first.{c}")).alias(name) for c, name in (("page_id", "refers_to"), ("url", "refers_url"), ("captured", "refers_captured"))]
    runs = joined.select("page_id", "url", "captured", "payload", *refers).mapInArrow(_archiver(path, archive_bytes, run_entries, level), _RUN_SQL)
    dealt = runs.withColumn("lists", F.floor(F.spark_partition_id() / LISTS)).repartition("lists").drop("lists")
    return written(dealt, "runs")


class Losers:
    """A tournament of sorted streams: inner nodes hold who lost there, so the next winner plays one match on each level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.k = max(1, len(streams))
        self.head = [self._next(s) for s in range(len(streams))] or [None]
        self.tree = [-1] * self.k
        for s in range(self.k):
            self._play(s)

    def _next(self, s: int) -> tuple | None:
        e = next(self.streams[s], None)
        return None if e is None else (_order(e), e)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a][0], a) < (self.head[b][0], b)

    def _play(self, winner: int) -> None:
        """Up from a leaf: at a node that nobody has reached yet the stream waits, at others the loser stays."""
        at = (winner + self.k) // 2
        while at:
            if self.tree[at] < 0:
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (own := self.head[best := self.tree[0]]) is not None:
            yield own[1]
            self.head[best] = self._next(best)
            self._play(best)


def _stream(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Entries of a run from low on and below high (key and time), from the block that low is in."""
    store, name = _open(path)
    with store.open_input_file(name) as handle:
        file = pa.ipc.open_file(handle)
        first = 0
        if low is not None:
            ahead = bisect.bisect_left(range(file.num_record_batches), low, key=lambda k: _head(file.get_batch(k)))
            first = max(0, ahead - 1)
        for k in range(first, file.num_record_batches):
            for e in zip(*(c.to_pylist() for c in file.get_batch(k).columns), strict=True):
                if high is not None and e[:2] >= high:
                    return
                if low is None or e[:2] >= low:
                    yield e


def _head(batch: pa.RecordBatch) -> tuple:
    return batch.column(0)[0].as_py(), batch.column(1)[0].as_py()


def _fewer(runs: DataFrame, path: str, groups: int) -> DataFrame:
    """Each group of runs as one run."""

    def merge(rows):
        streams = [_stream(p) for p in rows.column("path").to_pylist()]
        count = sum(rows.column("entries").to_pylist())
        return pa.Table.from_batches([_batch([_write_sorted(path, iter(Losers(streams)), count)], _RUN)])

    dealt = runs.withColumn("group", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int")).repartition(groups, "group")
    return written(dealt.groupBy("group").applyInArrow(merge, _RUN_SQL), "runs")


def _cuts(marks: list[tuple[tuple, int]], ranges: int) -> list[tuple]:
    """Keys between ranges of about equal weight; marks: key and weight."""
    marks, out, held, total = sorted(marks), [], 0, sum(w for _, w in marks)
    for key, weight in marks:
        if held * ranges >= (len(out) + 1) * total and (not out or key > out[-1]):
            out.append(key)
        held += weight
    return out


_MERGED = pa.schema([("range_no", pa.int32()), ("place", pa.int64()), *_ENTRY])


def merged(runs: DataFrame, path: str, fan: int = FAN, range_entries: int = RANGE) -> DataFrame:
    """All entries of runs in order: range_no, place (in the range), url_key, captured, page_id, archive, offset, size. path: a folder for runs between."""
    spark = runs.sparkSession
    while (count := runs.count()) > fan:
        runs = _fewer(runs, path, max(1, -(-count // fan)))
    last = runs.collect()  # at most fan rows
    ranges = max(1, -(-sum(r["entries"] for r in last) // range_entries))
    cuts = _cuts([((bytes(m["url_key"]), m["captured"]), max(1, r["entries"] // max(1, len(r["marks"])))) for r in last for m in r["marks"]], ranges)
    paths = [r["path"] for r in last]
    edges = [None, *cuts, None]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                place = 0
                for block in _blocks(iter(Losers([_stream(p, edges[k], edges[k + 1]) for p in paths])), READ_ROWS):
                    yield _batch([(k, place + i, *e) for i, e in enumerate(block)], _MERGED)
                    place += len(block)

    return spark.range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(merge, f"range_no int, place long, {_ENTRY_SQL}")


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("url_key", pa.string()),
    ("captured", pa.timestamp("us", "UTC")), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("range_no", pa.int32()), ("place", pa.int64()),
])
_RECORD_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured timestamp, payload binary, archive string, offset long, range_no int, place long"


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures (as merged gives them), read from their archives. A record that is damaged, or a payload without its digest, raises. Revisits have no payload."""

    def row(data: bytes, capture: dict) -> tuple:
        fields, length, payload = parsed(zlib.decompress(data, wbits=31))
        stated, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (digest(payload) != stated or len(payload) != length):
            raise ValueError(f"{capture['archive']}: the payload at {capture['offset']} is not the one that was archived")
        number = lambda name: int(fields[name]) if fields.get(name) else None
        own = payload if payloads and kind == "response" else None
        return number("X-Page-ID"), length, stated, kind, number("X-Refers-To-Page-ID"), fields["WARC-Target-URI"], bytes(capture["url_key"]).decode(), capture["captured"], own, capture["archive"], capture["offset"], capture["range_no"], capture["place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            captures, begin = batch.to_pylist(), 0
            while begin < len(captures):
                end, held = begin, 0
                while end < len(captures) and (end == begin or held + captures[end]["size"] <= READ_BYTES):
                    held += captures[end]["size"]
                    end += 1
                by_archive: dict[str, list[int]] = {}
                for k in range(begin, end):
                    by_archive.setdefault(captures[k]["archive"], []).append(k)
                rows: list = [None] * (end - begin)
                for name, places in by_archive.items():
                    store, path = _open(name)
                    with store.open_input_file(path) as handle:
                        for k in sorted(places, key=lambda k: captures[k]["offset"]):
                            rows[k - begin] = row(handle.read_at(captures[k]["size"], captures[k]["offset"]), captures[k])
                yield _batch(rows, _RECORD)
                begin = end

    return captures.mapInArrow(run, _RECORD_SQL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of capture: a second an id from 2024 on stands for it."""
    path = shared_dir(spark, "warc")
    runs = write_archives(table(spark, sf_dir, "pages"), path, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")))
    return read_records(merged(runs, path), payloads=False).drop("payload")
