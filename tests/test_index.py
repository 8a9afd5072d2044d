"""The index of records: lookups equal full scans, and need no other bytes than they plan."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditarium.sources import index, managed, wal

T0 = datetime(2024, 1, 1)
NANOS = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 10**9
EVENT = "sequence long, ts timestamp_ntz, event_data string, flags int, segment long"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("log"))
    rows = [(k, T0 + timedelta(seconds=k // 3), f"event {k} " + "x" * rng.choice((0, 10, 3000)), int(k % 10 == 3), (k - 1) // 100) for k in range(1, 501)]
    managed.append(spark.createDataFrame(rows, EVENT), path)
    return path


@pytest.mark.parametrize("every", [1, 7, 1000])
def test_lookups(spark, log, tmp_path, every):
    idx = index.build(spark, log, str(tmp_path), every, 3)
    whole = {r["sequence"]: r for r in wal.read_log(spark, log).collect()}
    assert idx.agg(F.sum("records")).first()[0] == 500 and idx.agg(F.sum("bytes")).first()[0] == sum(r["size"] for r in whole.values())
    for wanted in ([5], [1, 100, 101, 500], [0, 9999]):
        rows = index.find(spark, log, idx, wanted).collect()
        assert sorted(rows, key=lambda r: r["sequence"]) == [whole[s] for s in wanted if s in whole]
    table = spark.createDataFrame([(k,) for k in range(3, 600, 50)] + [(3,), (None,)], "sequence int")
    assert sorted(index.find(spark, log, idx, table).collect(), key=lambda r: r["sequence"]) == [whole[k] for k in range(3, 501, 50)]
    for low, high, first, last in ((10, 20, None, None), (None, 3, 5, None), (160, None, None, 490), (None, None, 99, 102), (9000, None, None, None)):
        at = lambda x: None if x is None else NANOS + x * 10**9
        got = sorted(r["sequence"] for r in index.between(spark, log, idx, at(low), at(high), first, last).collect())
        assert got == [k for k in range(1, 501) if (low is None or k // 3 >= low) and (high is None or k // 3 <= high) and (first is None or k >= first) and (last is None or k <= last)]


def test_only_planned_bytes_are_needed(spark, log, tmp_path):
    """All bytes outside of the planned ranges are overwritten; the lookup still holds."""
    idx = index.build(spark, log, f"{tmp_path}/index")
    plan = index.ranges(index.entries(idx, 210, 219), gap=0).collect()
    (r,) = plan
    sizes = idx.where("first_sequence between 210 and 219").agg(F.sum("bytes")).first()[0]
    assert r["end"] - r["start"] == sizes < os.path.getsize(r["path"]) / 4
    copy = f"{tmp_path}/copy/{os.path.basename(r['path'])}"
    os.makedirs(f"{tmp_path}/copy")
    data = bytearray(b"?" * os.path.getsize(r["path"]))
    data[r["start"] : r["end"]] = open(r["path"], "rb").read()[r["start"] : r["end"]]
    open(copy, "wb").write(data)
    moved = idx.withColumn("path", F.concat(F.lit(f"{tmp_path}/copy/"), F.element_at(F.split("path", "/"), -1)))
    assert sorted(x["sequence"] for x in index.between(spark, log, moved, first=210, last=219).collect()) == list(range(210, 220))


def test_ranges_are_joined_and_cut(spark):
    rows = spark.createDataFrame([("a", k * 100, 100) for k in range(10)] + [("a", 5000, 50), ("b", 0, 10)], "path string, offset long, span long")
    assert sorted(map(tuple, index.ranges(rows, gap=10).collect())) == [("a", 0, 1000), ("a", 5000, 5050), ("b", 0, 10)]
    assert sorted(map(tuple, index.ranges(rows, gap=1 << 20, most=400).collect())) == [("a", 0, 400), ("a", 400, 800), ("a", 800, 1000), ("a", 5000, 5050), ("b", 0, 10)]


def test_pruned_scan(spark, log, tmp_path):
    idx = index.build(spark, log, str(tmp_path), 1, 4)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = index.entries(idx, 10, 12)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(last_sequence,10)" in plan and "LessThanOrEqual(first_sequence,12)" in plan


def test_positional_scan_seeks(spark, log, tmp_path):
    rows = wal.read_log(spark, log).where("sequence <= 100").orderBy("offset").collect()
    at, path = rows[40]["offset"], rows[40]["path"]
    data = bytearray(open(path, "rb").read())
    data[:at] = b"?" * at
    copy = f"{tmp_path}/s.wal"
    open(copy, "wb").write(data)
    assert [r["sequence"] for r in wal.read_from(spark, copy, at).orderBy("offset").collect()] == list(range(41, 101))
    assert [r["sequence"] for r in wal.read_from(spark, copy, at + 5).where("parse_error is null").orderBy("offset").collect()] == list(range(42, 101))


def test_checksums_are_the_records(spark, log):
    from auditarium.sources import records

    row = wal.read_headers(spark, log).where("sequence = 7").first()
    raw = open(row["path"], "rb").read()[row["offset"] : row["offset"] + row["size"]]
    assert row["checksum"] == int.from_bytes(raw[-8:-4], "little") and records.record_at(raw, 0).sequence == 7
