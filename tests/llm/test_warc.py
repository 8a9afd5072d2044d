"""Web archives: round trips, who revisits whom, and the order of captures, against plain Python."""

import base64
import gzip
import hashlib
import random
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from auditarium.llm import warc

SCHEMA = "page_id long, url string, html string, at long, place string"


def brute(rows):
    """page_id, bytes, digest, type, refers_to of (page_id, html)."""
    best = {}
    for page_id, html in rows:
        best[html or ""] = max(best.get(html or "", page_id or -1), -1 if page_id is None else page_id)
    out = []
    for page_id, html in rows:
        raw, top = (html or "").encode(), best[html or ""]
        own = top < 0 or page_id == top
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_query(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    rows = __spark_entry__.queries()["op13_warc"](spark, sf).collect()
    assert got(rows) == brute([(p["page_id"], p["html"]) for p in pages])
    ordered = sorted(rows, key=lambda r: (r["range_no"], r["place"]))
    assert [(r["url_key"].encode(), r["captured"], r["page_id"]) for r in ordered] == sorted((warc.url_key(warc.encoded_url(p["url"])), datetime.fromtimestamp(1_704_067_200 + p["page_id"], UTC).replace(tzinfo=None), p["page_id"]) for p in pages)


def collection(n=400):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        host = rng.choice(("example.org", "WWW.Example.org", "a.example.org:8080", "hot.net"))
        html = rng.choice(("<p>hot</p>", "", None, f"<p>{k % 40} é\r\n\r\n</p>", f"<p>{k}</p>", "x" * 50_000))
        rows.append((k * 3 % n, f"https://{host}/p{rng.randint(0, 9)}?q={rng.randint(0, 3)}#f", html, rng.randint(0, 5), "x"))
    rows += [(n + 1, None, "<p>hot</p>", None, "y"), (n + 2, "no url \r\nX: 1", "<b>", 3, "y"), (None, "https://hot.net/", "<b>", 3, "y"), (None, "https://hot.net/", "alone", 3, "y"), (n + 1, None, "<p>hot</p>", None, "y")]
    return rows


@pytest.mark.parametrize(("run_entries", "fan", "entries"), [(1 << 16, 64, 8192), (7, 4, 20), (1, 3, 1), (50, 64, 1000)])
def test_merging_of_many_runs(spark, tmp_path, run_entries, fan, entries):
    rows = collection()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    runs = warc.write_archives(df, str(tmp_path), F.timestamp_seconds("at"), archive_bytes=20_000, run_entries=run_entries)
    captures = warc.merged(runs, str(tmp_path), fan, entries)
    found = warc.read_records(captures).collect()
    assert got(found) == brute([(r[0], r[2]) for r in rows])
    key = lambda p, u, at: (warc.url_key(warc.encoded_url(u)).decode(), at or 0, -1 if p is None else p)
    ordered = sorted(found, key=lambda r: (r["range_no"], r["place"]))
    assert [(r["url_key"], int(r["captured"].timestamp()), -1 if r["page_id"] is None else r["page_id"]) for r in ordered] == sorted(key(r[0], r[1], r[3]) for r in rows)
    texts = {r[0]: (r[2] or "") for r in rows if r[0] is not None}
    assert all(r["payload"] == texts[r["page_id"]].encode() for r in found if r["record_type"] == "response" and r["page_id"] is not None)
    if entries < 1000:
        assert len({r["range_no"] for r in found}) > 3


def test_tasks_share_files_of_lists(spark, tmp_path):
    rows, held = collection(), {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        runs = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path), F.timestamp_seconds("at"))
        listed, files = runs.count(), [f for f in runs.inputFiles() if spark.read.parquet(f).count()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert listed > 2 * len(files) and listed == len(list(tmp_path.glob("*.run")))
    assert got(warc.read_records(warc.merged(runs, str(tmp_path))).collect()) == brute([(r[0], r[2]) for r in rows])


def test_archives_are_plain_gzip_and_damage_is_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c", "<p>one</p>", 1, ""), (2, "http://a.b/c", "<p>one</p>", 2, "")], SCHEMA).coalesce(1)
    runs = warc.write_archives(df, str(tmp_path), F.timestamp_seconds("at"))
    (file,) = [f for f in tmp_path.iterdir() if f.name.endswith(".gz")]
    text = gzip.decompress(file.read_bytes()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("<p>one</p>") == 1 and "WARC-Refers-To-Date: 1970-01-01T00:00:02.000000Z" in text
    data = bytearray(file.read_bytes())
    data[60] ^= 255
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="error|not"):
        warc.read_records(warc.merged(runs, str(tmp_path))).collect()


def test_empty_table_and_long_pages(spark, tmp_path):
    df = spark.createDataFrame([(7, "http://a.b/" + "c" * 5000, "long " * 1_000_000, 1, "")], SCHEMA)
    found = warc.read_records(warc.merged(warc.write_archives(df, str(tmp_path)), str(tmp_path))).collect()
    assert got(found) == brute([(7, "long " * 1_000_000)]) and len(found[0]["payload"]) == 5_000_000
    none = warc.merged(warc.write_archives(df.where("false"), str(tmp_path / "none")), str(tmp_path / "none"))
    assert warc.read_records(none).count() == 0


def test_losers_merge_like_sort():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((bytes([rng.randint(97, 99)]), rng.randint(0, 3), rng.choice((None, 1, 2)), "a", rng.randint(0, 9), 1) for _ in range(rng.randint(0, 9))), key=warc._order) for _ in range(k)]
        assert list(warc.Losers([iter(r) for r in runs])) == sorted((e for r in runs for e in r), key=warc._order)


def test_url_keys():
    for url, key in (("https://www.Example.org/a?b=C#d", "org,example)/a?b=C"), ("http://a.b.c:8080", "c,b,a:8080)/"), ("http://u:p@x.y:443/z", "y,x)/z"), ("mailto:x", "mailto:x"), ("", ""), ("https:///x", "https:///x")):
        assert warc.url_key(url) == key.encode()


def test_runs_are_read_from_the_middle(tmp_path):
    entries = [(b"k%03d" % (i // 3), i % 3, i, "a", i, 1) for i in range(3000)]
    name, n, marks = warc._write_run(str(tmp_path), entries)
    assert n == 3000 and 256 <= len(marks) <= 700
    for low, high in (((b"k500", 1), (b"k700", 0)), (None, (b"k001", 0)), ((b"k999", 2), None), ((b"", 0), (b"", 1)), ((b"k170", 2), (b"k171", 0))):
        assert list(warc._stream(name, low, high)) == [e for e in entries if (low is None or e[:2] >= low) and (high is None or e[:2] < high)]
    assert pa.ipc.open_file(name).num_record_batches == 6
