"""Logs end to end: written, read, verified, damaged, recovered, compacted, exported, streamed; and the commands."""

import json
import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditarium import cli
from auditarium.functions.model import CompactionPolicy
from auditarium.operators import maintain, monitor, recover, replay, stats, verify
from auditarium.sources import export, records, wal
from auditarium.streaming import live

T0 = datetime(2024, 1, 1)
EVENT = "sequence long, ts timestamp_ntz, level int, event_data string, flags int, segment long, entity_id string"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def log(spark, n=200, per=100):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=k), k % 5, json.dumps({"MessageTemplate": "event {id}", "Level": k % 5, "Properties": {"id": str(k)}}), int(k % 10 == 3), (k - 1) // per, f"e{k % 7}") for k in range(1, n + 1)], EVENT)


def files(folder):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".wal"))


def test_round_trip_and_chain(spark, folder):
    wal.write_log(log(spark), folder)
    assert len(files(folder)) == 2
    for split in (32 << 20, 997):
        rec = wal.read_log(spark, folder, split_bytes=split)
        rows = rec.orderBy("sequence").collect()
        assert [r["sequence"] for r in rows] == list(range(1, 201)) and {r["parse_error"] for r in rows} == {None}
        assert wal.check_records(rec).where("not linked").count() == 0
    assert wal.read_log(spark, folder, include_deleted=False).count() == 180
    assert wal.read_log(spark, folder).where("sequence > 150 and ts_nanos >= 0").count() == 50
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert wal.read_log(spark, folder).where("sequence > 150 and sequence <= 160").count() == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_rotation_keeps_the_chain(spark, folder):
    wal.write_log(log(spark, 100), folder, segment_bytes=2000)
    assert len(files(folder)) > 3
    rows = wal.read_log(spark, folder).orderBy("sequence").collect()
    assert all(a["hash"] == b["prev_hash"] for a, b in zip(rows, rows[1:], strict=False))


def test_damage_is_found_and_repaired(spark, folder):
    wal.write_log(log(spark), folder)
    path = files(folder)[0]
    data = bytearray(open(path, "rb").read())
    rows = [x for x in records.split(bytes(data)) if isinstance(x, records.Record)]
    data[rows[9].offset + 70] ^= 1
    data[rows[20].offset + 13] ^= 2
    del data[rows[99].offset + 5 :]
    open(path, "wb").write(data)
    rec = recover.recover(spark, folder)
    report = recover.report(rec).first()
    assert (report["recovered"], report["corrupted"], report["last_good_sequence"]) == (197, 3, 200)
    assert report["bytes_skipped"] == rows[9].size + rows[20].size + 5
    assert wal.check_records(rec).where("not linked").count() == 3  # behind both records, and behind the cut end of the first file
    found = {(r["kind"], bytes(r["data"])) for r in recover.salvage(spark, folder).collect()}
    assert ("header", rows[20].event_data) in found
    out = f"{folder}-repaired"
    wal.write_log(recover.repaired(rec), out)
    again = recover.report(recover.recover(spark, out)).first()
    assert (again["recovered"], again["corrupted"]) == (197, 0)
    assert wal.check_records(recover.recover(spark, out)).where("not linked").count() == 0
    assert recover.report(rec, "path").count() == 2
    assert wal.read_log(spark, folder, "STOP_AT_ERROR").where("parse_error is null").count() == 9 + 100


def test_long_damage_is_reported_by_each_split(spark, tmp_path):
    from auditarium.sources import records

    raw = records.encode(1, 9, b"{}")
    (tmp_path / "a.wal").write_bytes(raw + b"x" * 5000 + raw)
    rows = wal.read_log(spark, str(tmp_path), max_record_size=100, split_bytes=1000).orderBy("offset").collect()
    assert sum(r["size"] for r in rows if r["parse_error"]) == 5000 and sum(r["size"] for r in rows) == 5000 + 2 * len(raw)
    assert sorted({k for r in rows for k in range(r["offset"], r["offset"] + r["size"])}) == list(range(5000 + 2 * len(raw)))


def test_journal_source(spark, folder):
    with open(f"{folder}/a.journal", "wb") as f:
        f.write(b"".join(records.journal_entry(at, b"data", k == 1) for k, at in enumerate((0, 100, 200))))
    assert [(r["position"], bytes(r["data"])) for r in wal.incomplete(wal.read_journal(spark, folder)).orderBy("position").collect()] == [(0, b"data"), (200, b"data")]


def test_ranges(spark):
    ev = log(spark, 100)
    at = lambda s: str(T0 + timedelta(seconds=s))
    assert replay.replay(ev, at(30), at(60)).count() == 31 and replay.replay(ev, at(30), at(60), "exclusive").count() == 29
    assert replay.replay(ev, None, at(5)).count() == 5 and replay.replay(ev).count() == 100
    with pytest.raises(ValueError, match="after"):
        replay.replay(ev, at(2), at(1))
    with pytest.raises(LookupError):
        replay.found(ev, 3, only_live=True)
    assert replay.found(ev, 3)["flags"] == 1


def test_level_cycle(spark):
    row = stats.level_counts(spark.createDataFrame([((4, 3, 2, 1, 0)[k % 5],) for k in range(100)], "level int")).first()
    assert (row["total"], row["errors"], row["warnings"], row["infos"], row["debugs"]) == (100, 20, 20, 20, 40)


def test_live_ratio(spark):
    rows = [(k, 0, int(k in (2, 4, 8)), "entity_1" if 3 <= k <= 6 else None, 100) for k in range(1, 11)]
    ev = spark.createDataFrame(rows, "sequence long, segment long, flags int, entity_id string, size long")
    assert {r["sequence"] for r in stats.with_live(ev).where("live").collect()} == {1, 6, 7, 9, 10}
    assert stats.live_ratio(ev).first()["ratio"] == 0.5
    assert stats.live_ratio(ev.where("flags = 0").withColumn("entity_id", F.lit(None).cast("string"))).first()["ratio"] == 1


def test_eligibility_and_groups(spark):
    seg = spark.createDataFrame([(1, True, T0 - timedelta(hours=48), 500, 0.9), (2, True, T0 - timedelta(hours=1), 2 << 20, 0.9), (3, False, T0 - timedelta(hours=99), 1024, 0.1)], "segment long, sealed boolean, created_at timestamp_ntz, size long, ratio double")
    assert [r["segment"] for r in maintain.eligible(seg, CompactionPolicy(min_segment_size=1024), str(T0)).collect()] == [1]
    sizes = (1024, 1024, 1024, 100 << 20, 1024)
    seg = spark.createDataFrame([(k, k, s) for k, s in enumerate(sizes, 1)], "segment long, start_seq long, size long")
    policy = CompactionPolicy(min_segments=0, min_segment_size=0, target_size=10 << 10)
    assert [r["segments"] for r in maintain.pack(seg, policy).orderBy("group_no").collect()] == [[1, 2, 3], [4], [5]]
    assert maintain.pack(seg.limit(0), policy).count() == 0


def test_chain_gaps_and_merkle(spark):
    ev = log(spark, 50, 10)
    assert verify.check_chain(verify.chained(ev)).where("not linked").count() == 0
    assert [(r["sequence"], r["missing"]) for r in verify.check_gaps(ev.where("sequence not between 8 and 23")).collect()] == [(24, 16)]
    import hashlib

    h = [hashlib.sha256(r["event_data"].encode()).hexdigest() for r in ev.orderBy("sequence").collect()]
    while len(h) > 1:
        h = [hashlib.sha256((h[k] + (h[k + 1] if k + 1 < len(h) else h[k])).encode()).hexdigest() for k in range(0, len(h), 2)]
    for step in (1, 3, 10):
        assert verify.merkle_root(ev, 50, step).first()["root"] == h[0]


def test_breaker(spark):
    calls = [(t, ok) for t, ok in zip((1, 2, 3, 4, 5, 6, 30, 66, 67, 140, 141), (0, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0), strict=True)]
    rows = spark.createDataFrame([("a", float(t), bool(ok)) for t, ok in calls] + [("b", 1.0, False)], "component string, at double, ok boolean")
    assert [tuple(r) for r in monitor.breaker(rows).orderBy("at").collect()] == [("a", 5.0, "open"), ("a", 66.0, "half-open"), ("a", 66.0, "open"), ("a", 140.0, "half-open"), ("a", 140.0, "closed")] 


def test_exports(spark, folder):
    rows = [(T0 - timedelta(hours=2 - k), (2, 3, 4)[k], "{UserId} {Action}", {"UserId": f"u{k}", "Action": "in"}, None) for k in range(3)]
    ev = spark.createDataFrame(rows, "ts timestamp_ntz, level int, message_template string, properties map<string,string>, exception string").coalesce(1)
    for fmt in export.FORMATS:
        export.export(ev, f"{folder}/{fmt}", fmt)
    read = lambda fmt: open(next(f"{folder}/{fmt}/{f}" for f in os.listdir(f"{folder}/{fmt}") if f.startswith("part-"))).read()
    assert len(json.loads(read("json"))) == 3
    assert len(read("jsonl").splitlines()) == 3
    assert read("csv").splitlines()[0] == ",".join(export.COLUMNS) and len(read("csv").splitlines()) == 4
    assert read("text").splitlines()[2] == "[2024-01-01T00:00:00Z] ERR: u2 in"
    with pytest.raises(ValueError):
        export.export(ev, folder, "xml")


def test_days(spark, folder):
    ev = log(spark, 10).withColumn("ts", F.expr("ts + make_dt_interval(sequence)").cast("timestamp_ntz")).select("sequence", "ts", "level")
    export.write_days(ev, f"{folder}/days")
    back = export.read_days(spark, f"{folder}/days", "sequence long, ts timestamp_ntz, level int", "2024-01-03 00:00:00", "2024-01-06 00:00:00")
    assert sorted(r["sequence"] for r in back.collect()) == [2, 3, 4]


def test_streams(spark, folder):
    ev = log(spark, 60, 30)
    ev.write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(ev.schema).parquet(f"{folder}/in")
    q = live.ingest(stream(), f"{folder}/out", f"{folder}/c1")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/out").count() == 60
    q = live.counts(stream()).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("events"), F.sum("errors")).first()[:] == (60, 12)
    q = live.alerts(stream(), 4).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{folder}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["segment"], r["alerts"]) for r in spark.table("alerts").collect()} == {(0, 1), (1, 1)}
    q = live.replicate(stream(), {"a": f"{folder}/a", "b": f"{folder}/b"}, f"{folder}/c4")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/a").count() == spark.read.parquet(f"{folder}/b").count() == 60


def test_commands(spark, folder, capsys):
    wal.write_log(log(spark), folder)

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out

    assert run("version") == (0, f"{cli.VERSION}\n")
    code, out = run("verify", "--wal", folder)
    assert code == 0 and json.loads(out)["records"] == 200
    code, out = run("replay", "--wal", folder, "--start", "2024-01-01T00:00:10Z", "--end", "2024-01-01T00:00:12Z")
    assert out.splitlines() == [f"[2024-01-01T00:00:{k}Z] {('VRB', 'DBG', 'INF', 'WRN', 'ERR')[k % 5]}: event {k}" for k in (10, 11, 12)]
    code, out = run("replay", "--wal", folder, "--format", "json", "--filter", "level >= 4")
    assert len(out.splitlines()) == 40
    code, out = run("stats", "--wal", folder, "--format", "json")
    assert json.loads(out)["total"] == 200
    assert run("export", "--wal", folder, "--format", "csv", "--output", f"{folder}/csv")[0] == 0
    assert run("compact", "--wal", folder, "--force", "--output", f"{folder}/small")[0] == 0
    assert wal.read_log(spark, f"{folder}/small").count() == 180
    code, out = run("recover", "--wal", folder)
    assert json.loads(out)["corrupted"] == 0
    code, out = run("monitor", "--wal", folder, "--interval", "1", "--checks", "2")
    assert [json.loads(x)["records"] for x in out.splitlines()] == [200, 200]
    path = files(folder)[0]
    data = bytearray(open(path, "rb").read())
    data[random.Random(1).randrange(100, 2000)] ^= 8
    open(path, "wb").write(data)
    assert run("verify", "--wal", folder)[0] == 1


def lost(spark, folder, number):
    """The log without one of its files."""
    os.remove(files(folder)[number])
    return wal.check_records(wal.read_log(spark, folder)).where("not linked")


@pytest.mark.parametrize(("number", "sequence"), [(0, 51), (1, 101)])
def test_a_lost_segment_breaks_the_chain(spark, folder, number, sequence, capsys):
    ev = log(spark, 200, 50)
    chained = verify.chained(ev)
    assert verify.check_chain(chained).where("not linked").count() == 0
    assert [r["sequence"] for r in verify.check_chain(chained.where(F.col("segment") != number)).where("not linked").collect()] == [sequence]
    assert not verify.integrity_report(verify.check_chain(chained.where(F.col("segment") != number))).first()["valid"]
    wal.write_log(ev, folder)
    assert cli.main(["verify", "--wal", folder], spark) == 0
    assert [r["sequence"] for r in lost(spark, folder, number).collect()] == [sequence]
    assert cli.main(["verify", "--wal", folder], spark) == 1


def test_a_log_is_continued(spark, folder):
    wal.write_log(log(spark, 100, 50), folder)
    wal.continue_log(log(spark, 40, 20), folder)
    rows = wal.read_log(spark, folder).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, 141)) and rows[100]["prev_hash"] == rows[99]["hash"]
    assert wal.check_records(wal.read_log(spark, folder)).where("not linked").count() == 0
    wal.continue_log(log(spark, 5, 20), f"{folder}/new")
    assert wal.last_record(spark, f"{folder}/new")[:2] == (0, 5) and wal.check_records(wal.read_log(spark, f"{folder}/new")).where("not linked").count() == 0


def test_archive(spark, folder):
    wal.write_log(log(spark, 100, 50), folder)
    moved = wal.archive_segments(folder, files(folder)[:1])
    assert len(files(folder)) == 1 and [os.path.exists(p) for p in moved] == [True]
    assert wal.clean_archive(folder, datetime(2000, 1, 1)) == [] and len(wal.clean_archive(folder, datetime(2100, 1, 1))) == 1
    assert wal.clean_archive(f"{folder}", datetime(2100, 1, 1)) == [] and not os.path.exists(moved[0])


def test_range_compaction_and_vacuum(spark):
    ev = log(spark, 100, 20).withColumn("size", F.lit(1).cast("long"))
    seg = replay.segments(ev).withColumn("sealed", F.col("segment") < 4)
    small = maintain.compact_range(ev, seg, 25, 45)
    assert {(r["segment"], r["count"]) for r in small.groupBy("segment").count().collect()} == {(0, 20), (1, 36), (3, 20), (4, 20)}
    assert maintain.compact_range(ev, seg, 25, 30).exceptAll(ev).count() == 0 and maintain.compact_range(ev, seg, 25, 30).count() == 100
    left = maintain.vacuumed(ev, seg)
    assert left.count() == 92 and left.where("segment = 4").count() == 20 and maintain.vacuumed(ev, seg, 0.2).count() == 100


def test_merkle_proofs(spark):
    ev = log(spark, 37, 10).where("sequence <> 13")
    root = verify.merkle_root(ev, 36).first()["root"]
    for step in (2, 10):
        proofs = verify.merkle_proofs(ev, spark.createDataFrame([(1,), (14,), (37,), (13,), (99,)], "sequence long"), 36, step)
        checked = verify.check_proofs(proofs, root).collect()
        assert {r["sequence"] for r in checked} == {1, 14, 37} and all(r["valid"] and len(r["proof"]) == 6 for r in checked)
        assert not any(r["valid"] for r in verify.check_proofs(proofs.withColumn("hash", F.sha2("hash", 256)), root).collect())


def test_forensics(spark, folder):
    wal.write_log(log(spark, 60, 30), folder)
    wal.write_log(log(spark, 60, 30), f"{folder}/shadow")
    path = files(folder)[0]
    data = bytearray(open(path, "rb").read())
    rows = [x for x in records.split(bytes(data)) if isinstance(x, records.Record)]
    data[rows[5].offset + 13] ^= 2  # a bit of the header
    data[rows[9].offset + 62] ^= 3  # two bits of the hash before it: the JSON is whole
    data[rows[14].offset + 70] ^= 2  # a bit of the payload
    del data[rows[29].offset + records.HEAD.size + 20 :]
    open(path, "wb").write(data)
    found = {r["method"]: r["pieces"] for r in recover.forensic_report(recover.forensic(spark, folder, f"{folder}/shadow")).collect()}
    assert found == {"standard": 56, "header": 1, "payload": 1, "json": 1, "tail": 1, "shadow": 4}
    rec = recover.recover(spark, folder)
    assert {(r["sequence"], r["kind"]) for r in recover.broken_links(rec).collect()} == {(1, "start"), (31, "start"), (7, "lost"), (11, "lost"), (16, "lost")}
    assert recover.chain_map(rec).count() == 56
    assert {r["kind"] for r in recover.broken_links(rec.where("sequence not in (3)").union(rec.where("sequence = 3").withColumn("offset", F.lit(10**9).cast("long")))).where("sequence in (3, 4)").collect()} == {"fork"}


def test_filters_name_levels(spark):
    ev = log(spark, 50)
    for text, n in (("level >= ERROR", 10), ("LEVEL = 'warning' and sequence > 5", 9), ("level < INF", 20), ("level >= 3", 20)):
        assert replay.query(ev, filters=[text]).count() == n
    with pytest.raises(ValueError, match="after"):
        replay.replay(ev, datetime(2024, 1, 2), "2024-01-01T23:00:00")


def test_replay_csv_and_values_that_look_like_holes(spark, folder, capsys):
    import csv as plain_csv
    import io

    event = json.dumps({"Timestamp": "x", "Level": 3, "MessageTemplate": "Hi {A(} {A} {B} \"q\", {x:y}", "Properties": {"A": "{B}", "B": "x", "A(": "$1\\"}})
    wal.write_log(spark.createDataFrame([(1, T0, 3, event, 0, 0, "e")], EVENT), folder)
    capsys.readouterr()
    assert cli.main(["replay", "--wal", folder, "--format", "csv"], spark) == 0
    rows = list(plain_csv.reader(io.StringIO(capsys.readouterr().out)))
    assert rows[0] == ["Timestamp", "Level", "Message", "Properties"] and rows[1][1:3] == ["WRN", 'Hi $1\\ {B} x "q", {x:y}']
    assert json.loads(rows[1][3]) == {"A": "{B}", "B": "x", "A(": "$1\\"}


def test_stats_tell_of_files(spark, folder, capsys):
    wal.write_log(log(spark), folder)
    capsys.readouterr()
    cli.main(["stats", "--wal", folder, "--format", "json"], spark)
    row = json.loads(capsys.readouterr().out)
    assert (row["total"], row["files"], row["has_corruption"], row["is_sealed"], row["duration_micros"]) == (200, 2, False, False, 199_000_000) and row["created_at"] <= row["modified_at"]
    data = bytearray(open(files(folder)[0], "rb").read())
    data[500] ^= 1
    open(files(folder)[0], "wb").write(data)
    cli.main(["stats", "--wal", folder, "--format", "json"], spark)
    assert json.loads(capsys.readouterr().out)["has_corruption"]
    assert cli.main(["compact", "--wal", folder, "--start", "1", "--end", "150", "--output", f"{folder}/c"], spark) == 0 and len(files(f"{folder}/c")) == 1
    assert cli.main(["vacuum", "--wal", folder, "--output", f"{folder}/v"], spark) == 0
    assert cli.main(["recover", "--wal", folder, "--no-skip-corrupted", "--verify-checksum", "--forensic"], spark) == 1


def test_files_are_pruned_by_the_time_in_their_names(spark, folder):
    from auditarium.sources import catalog

    for name, hour in (("audit-20240101-000000.json", 0), ("audit-20240101-050000.json", 5), ("audit-20240101-090000.json", 9), ("audit-old.json", 1)):
        with open(f"{folder}/{name}", "w") as f:
            f.write(json.dumps({"ts": f"2024-01-01 0{hour}:30:00", "n": hour}) + "\n")
    names = lambda end: [os.path.basename(p) for p in catalog.lines_until(folder, end)]
    assert names("2024-01-01 06:00:00") == ["audit-20240101-000000.json", "audit-20240101-050000.json", "audit-old.json"] and len(names(None)) == 4
    assert [r["n"] for r in catalog.read_lines(spark, folder, "ts timestamp_ntz, n int", "2024-01-01 00:45:00", "2024-01-01 06:00:00").orderBy("n").collect()] == [1, 5]
    assert catalog.read_lines(spark, folder, "ts timestamp_ntz, n int", None, "2020-01-01 06:00:00").count() == 0


def test_manifest_of_days(spark, folder):
    ev = log(spark, 10).withColumn("ts", F.expr("ts + make_dt_interval(0, sequence)").cast("timestamp_ntz")).select("sequence", "ts", "level")
    export.write_days(ev, f"{folder}/days")
    rows = export.manifest(spark, f"{folder}/days").collect()
    assert sum(r["records"] for r in rows) == 10 and all(r["md5_b64"] and r["first_time"] <= r["last_time"] and r["name"].startswith("year=2024/month=1") for r in rows)


def test_cycles_follow_the_policy(spark):
    ev = log(spark, 100, 20).withColumn("size", F.lit(1000).cast("long"))
    seg = replay.segments(ev).withColumn("sealed", F.col("segment") < 4).withColumn("created_at", F.col("start_time")).withColumn("ratio", F.when(F.col("segment") == 1, 0.9).otherwise(0.2))
    policy = CompactionPolicy(min_segments=2, min_segment_size=1, target_size=45_000, ratio=0.5)
    late = str(T0 + timedelta(days=3))
    after = {(r["segment"], r["count"]) for r in maintain.compact_cycle(ev, seg, policy, late).groupBy("segment").count().collect()}
    assert after == {(0, 36), (1, 20), (3, 18), (4, 20)}  # 0 and 2 are a group, 3 is full enough alone
    assert maintain.compact_cycle(ev, seg, policy, str(T0)).exceptAll(ev).count() == 0


def test_index_scan_and_checked_scan(spark, folder):
    wal.write_log(log(spark), folder)
    rows = wal.read_headers(spark, folder).orderBy("sequence").collect()
    full = wal.read_log(spark, folder).orderBy("sequence").collect()
    assert [(r["path"], r["offset"], r["size"], r["sequence"], r["prev_hash"]) for r in rows] == [(r["path"], r["offset"], r["size"], r["sequence"], r["prev_hash"]) for r in full]
    assert wal.checked_scan(wal.read_log(spark, folder)).count() == 200
    with open(f"{folder}/z.wal", "wb") as f:
        f.write(b"no log at all")
    with pytest.raises(ValueError, match="z.wal"):
        wal.checked_scan(wal.read_log(spark, folder), 0)
    assert wal.read_log(spark, folder, files=["z.wal"]).count() == 1
