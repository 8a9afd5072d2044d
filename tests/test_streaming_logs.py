"""Logs as streams: growing files, half-written records, restarts; and streams as logs: epochs written once."""

import json
from datetime import datetime, timedelta

import pytest

from auditarium import cli
from auditarium.sources import managed, manifest, records, wal
from auditarium.streaming import live, source

T0 = datetime(2024, 1, 1)


def chain(first, n, prev=records.ZERO, size=20):
    out = []
    for k in range(first, first + n):
        raw = records.encode(k, k, b"x" * size, prev)
        prev = records.hashlib.sha256(raw).digest()
        out.append(raw)
    return b"".join(out), prev


class Follower:
    """Runs a stream to its end, again and again, with one checkpoint; got: what each run brought."""

    def __init__(self, spark, path, folder, **options):
        self.spark, self.path, self.folder, self.options, self.got = spark, path, folder, options, []

    def run(self):
        rows = []
        query = source.follow(self.spark, self.path, **self.options).writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).option("checkpointLocation", self.folder).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows.sort(key=lambda r: (r["path"], r["offset"]))
        return [r["sequence"] or r["parse_error"] for r in rows]


def test_growing_files(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    follower = Follower(spark, str(log), str(tmp_path / "check"), splitBytes=200)
    assert follower.run() == []
    one, prev = chain(1, 10)
    more, prev = chain(11, 5, prev)
    (log / "000-a.wal").write_bytes(one + more[:30])  # the eleventh record is being written
    assert follower.run() == list(range(1, 11))
    assert follower.run() == []
    (log / "000-a.wal").write_bytes(one + more)
    two, _ = chain(16, 4)
    (log / "001-b.wal").write_bytes(two)
    assert follower.run() == list(range(11, 20))
    bad = bytearray(chain(20, 3)[0])
    bad[len(bad) // 3 + 70] ^= 1
    (log / "001-b.wal").write_bytes(two + bytes(bad[: 2 * len(bad) // 3]))
    assert follower.run() == [20]  # damage waits for what stands behind it
    (log / "001-b.wal").write_bytes(two + bytes(bad))
    assert follower.run() == ["checksum", 22]


def test_closed_files_are_read_to_their_ends(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for k in range(4):
        (log / f"{k}.wal").write_bytes(chain(1 + 5 * k, 5)[0] + b"?" * 3)
    follower = Follower(spark, str(log), str(tmp_path / "check"), openFiles=2)
    assert follower.run() == [1, 2, 3, 4, 5, "short", 6, 7, 8, 9, 10, "short", *range(11, 21)]
    (log / "4.wal").write_bytes(chain(21, 2)[0])
    assert follower.run() == ["short", 21, 22]
    offsets = json.loads(max((tmp_path / "check/offsets").glob("[0-9]*"), key=lambda p: int(p.name)).read_text().splitlines()[-1])
    assert offsets["done"] == "2.wal" and sorted(offsets["at"]) == ["3.wal", "4.wal"]


def test_whole_until():
    raw, _ = chain(1, 3, size=100_000)
    small, _ = chain(4, 3)
    data = raw + small
    at = lambda n, start: data[start : start + n]
    ends = [r.offset + r.size for r in records.split(data)]
    for size in (0, 50, ends[0] - 1, ends[0], ends[2] - 1, ends[2] + 5, ends[4], len(data) - 1, len(data)):
        assert source.whole_until(at, size, 0) == max((e for e in ends if e <= size), default=0), size
    assert source.whole_until(at, len(data), ends[3]) == ends[5] and source.whole_until(at, ends[4] - 1, ends[3]) == ends[3]


def events(spark, first, n):
    return spark.createDataFrame([(T0 + timedelta(seconds=k), f"event {k}", 0) for k in range(first, first + n)], "ts timestamp_ntz, event_data string, flags int")


def test_a_stream_becomes_a_log_and_is_followed(spark, tmp_path):
    data, path, check = str(tmp_path / "data"), str(tmp_path / "log"), str(tmp_path / "check")
    events(spark, 1, 30).coalesce(1).write.parquet(data)
    events(spark, 31, 20).coalesce(1).write.mode("append").parquet(data)
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, event_data string, flags int").option("maxFilesPerTrigger", 1).parquet(data)
    live.append(stream(), path, check, segment_bytes=1000).awaitTermination(120)
    state = manifest.load(path)
    assert state.generation == 2 and state.epochs == {"stream": 1}
    assert sorted(r["sequence"] for r in managed.read(spark, path).collect()) == list(range(1, 51))
    follower = Follower(spark, path, str(tmp_path / "follow"))
    assert sorted(follower.run()) == list(range(1, 51))
    # the query ended between the log's commit and its own: the batch comes again, and is told
    for commit in (tmp_path / "check/commits").glob("*1*"):
        commit.unlink()
    live.append(stream(), path, check, segment_bytes=1000).awaitTermination(120)
    assert manifest.load(path).generation == 2
    events(spark, 51, 5).coalesce(1).write.mode("append").parquet(data)
    live.append(stream(), path, check, segment_bytes=1000).awaitTermination(120)
    managed.mark_deleted(spark, path, spark.createDataFrame([(3,)], "sequence long"))
    managed.vacuum(spark, path, 0.01)
    assert sorted(follower.run()) == list(range(51, 56))  # rewriting brings nothing
    assert managed.report(spark, path).first()["valid"]


def test_monitor_goes_on_counting(spark, tmp_path):
    log, told = tmp_path / "log", []
    log.mkdir()
    raw, prev = chain(1, 10)
    (log / "0.wal").write_bytes(raw)
    run = lambda: live.monitor(source.follow(spark, str(log)), str(tmp_path / "check"), lambda r: told.append(tuple(r))).awaitTermination(120)
    run()
    bad = bytearray(chain(11, 5, prev)[0])
    bad[65] ^= 1
    (log / "0.wal").write_bytes(raw + bytes(bad))
    run()
    assert told[0] == (10, 0, len(raw), 10) and told[-1] == (14, 1, len(raw) + len(bad), 15)


@pytest.mark.parametrize("break_it", [False, True])
def test_verify_command(spark, tmp_path, capsys, break_it):
    path = str(tmp_path / "log")
    managed.append(managed.numbered(events(spark, 1, 20), path), path, 700)
    name = manifest.load(path).ordered()[1]["name"]
    if break_it:
        data = bytearray(open(f"{path}/{name}", "rb").read())
        data[66] ^= 1
        open(f"{path}/{name}", "wb").write(data)
    assert cli.main(["verify", "--wal", path], spark) == int(break_it)
    out = json.loads(capsys.readouterr().out)
    assert out["valid"] is not break_it and out["damaged"] == int(break_it) and len(out["seal"]) == 64
    assert cli.main(["verify", "--wal", path, "--seal", "0" * 63 + "1"], spark) == 1
    plain = str(tmp_path / "plain")
    wal.write_log(managed.numbered(events(spark, 1, 20), plain).selectExpr("sequence", "ts", "event_data", "flags", "0 as segment"), plain)
    capsys.readouterr()
    assert cli.main(["verify", "--wal", plain], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"valid": True, "records": 20, "damaged": 0, "chain_breaks": 0, "last_sequence": 20}
