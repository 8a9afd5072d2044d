"""Managed logs: seals against forgeries, generations, commits that meet, compaction, vectors, and what a crash leaves."""

import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditarium.functions.model import CompactionPolicy
from auditarium.sources import managed, manifest, records, wal

T0 = datetime(2024, 1, 1)
EVENT = "sequence long, ts timestamp_ntz, event_data string, flags int, segment long"
POLICY = CompactionPolicy(min_segments=2, target_size=1 << 20, min_segment_size=1 << 19, ratio=0.7)


def events(spark, first=1, n=40, per=10, text="event"):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=k), f"{text} {k}", 0, (k - 1) // per) for k in range(first, first + n)], EVENT)


def sequences(df):
    return sorted(r["sequence"] for r in df.select("sequence").collect())


def wals(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".wal"))


def status(spark, folder):
    return [(r["status"], r["sealed"]) for r in managed.check(spark, folder).orderBy("place").collect()]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "log")
    managed.append(events(spark), path)
    return path


def test_a_whole_log_is_valid(spark, folder):
    assert status(spark, folder) == [("ok", True)] * 4
    seal = manifest.load(folder).seal
    managed.append(events(spark, 41, 10), folder)
    for s in (None, seal, manifest.load(folder).seal):
        row = managed.report(spark, folder, s).first()
        assert row["valid"] and row["segments"] == 5
    assert not managed.report(spark, folder, "0" * 63 + "1").first()["valid"]
    assert sequences(managed.read(spark, folder)) == list(range(1, 51)) == sequences(wal.read_log(spark, folder))


def test_a_segment_replaced_as_a_whole_is_told(spark, folder, tmp_path):
    """The forged file has the same sequences and times, a chain of its own, and holds in itself."""
    forged = str(tmp_path / "forged")
    wal.write_log(events(spark, 11, 10, text="forged"), forged)
    os.replace(f"{forged}/{wals(forged)[0]}", f"{folder}/{wals(folder)[1]}")
    rec = wal.read_log(spark, folder)
    checked = wal.check_records(rec)
    assert checked.where("not linked").count() == 0 and sequences(checked.where("not bound")) == [1, 11, 21, 31]  # without a manifest borders are unproven
    assert status(spark, folder) == [("ok", True), ("replaced", False), ("ok", False), ("ok", False)]
    row = managed.report(spark, folder).first()
    assert not row["valid"] and (row["replaced"], row["unsealed"]) == (1, 3)


def test_a_forged_manifest_needs_all_seals_anew_and_a_noted_one_tells(spark, folder, tmp_path):
    managed.append(events(spark, 41, 10), folder)
    noted = manifest.load(folder).seal
    # the newest generation and its segment are cut off: what is left is whole, and only the noted seal tells
    os.remove(f"{folder}/{wals(folder)[-1]}")
    assert status(spark, folder)[-1] == ("missing", False)
    os.remove(f"{folder}/_manifest/{2:020d}.json")
    assert managed.report(spark, folder).first()["valid"] and not managed.report(spark, folder, noted).first()["valid"]
    # a line of the manifest is changed
    name = f"{folder}/_manifest/{1:020d}.json"
    text = open(name).read()
    open(name, "w").write(text.replace('"records": 10', '"records": 9', 1))
    row = managed.report(spark, folder).first()
    assert not row["valid"] and not row["history_ok"]


def test_damage_and_breaks_are_told_apart(spark, folder):
    names = wals(folder)
    data = bytearray(open(f"{folder}/{names[2]}", "rb").read())
    data[70] ^= 1
    open(f"{folder}/{names[2]}", "wb").write(data)
    raw = open(f"{folder}/{names[0]}", "rb").read()
    rows = list(records.split(raw))
    open(f"{folder}/{names[0]}", "wb").write(raw[: rows[3].offset] + raw[rows[4].offset :])  # a record taken out
    assert [s for s, _ in status(spark, folder)] == ["broken", "ok", "damaged", "ok"]


def test_marking_rewrites_nothing(spark, folder):
    before = {f: (os.stat(f"{folder}/{f}").st_mtime_ns, os.stat(f"{folder}/{f}").st_size) for f in wals(folder)}
    gone = spark.createDataFrame([(3,), (17,), (18,), (99,), (None,)], "sequence long")
    managed.mark_deleted(spark, folder, gone)
    managed.mark_deleted(spark, folder, spark.createDataFrame([(4,), (3,)], "sequence long"))
    assert before == {f: (os.stat(f"{folder}/{f}").st_mtime_ns, os.stat(f"{folder}/{f}").st_size) for f in wals(folder)}
    assert sequences(managed.read(spark, folder, include_deleted=False)) == [k for k in range(1, 41) if k not in (3, 4, 17, 18)]
    assert sequences(managed.read(spark, folder).where("flags = 1")) == [3, 4, 17, 18] and len(sequences(managed.read(spark, folder))) == 40
    assert [e["deleted"] for e in manifest.load(folder).ordered()] == [2, 2, 0, 0]
    assert sequences(managed.read(spark, folder, 1, include_deleted=False)) == list(range(1, 41))  # the generation before
    assert managed.report(spark, folder).first()["valid"]
    assert managed.mark_deleted(spark, folder, spark.createDataFrame([(1000,)], "sequence long")).generation == 3


def test_compaction_is_one_commit(spark, folder):
    managed.mark_deleted(spark, folder, spark.createDataFrame([(3,), (17,)], "sequence long"))
    held = managed.read(spark, folder)  # begun before, read after
    state = managed.compact(spark, folder, POLICY, "2024-02-01 00:00:00")
    assert [(e["first_sequence"], e["last_sequence"], e["records"], e["vector"]) for e in state.ordered()] == [(1, 30, 28, None), (31, 40, 10, None)]
    assert sequences(held) == list(range(1, 41)) and sequences(managed.read(spark, folder)) == [k for k in range(1, 41) if k not in (3, 17)]
    assert managed.report(spark, folder).first()["valid"] and wal.check_records(managed.read(spark, folder)).where("not inner").count() == 0
    assert managed.compact(spark, folder, CompactionPolicy(min_segment_size=1, ratio=0.1), "2024-02-01 00:00:00").generation == state.generation
    assert len(managed.clean(folder, keep=1)) == 5 and len(wals(folder)) == 2  # three segments and two vectors
    assert sequences(managed.read(spark, folder)) == [k for k in range(1, 41) if k not in (3, 17)] and managed.report(spark, folder).first()["valid"]


def test_a_crash_before_the_commit_leaves_the_old_log(spark, folder, monkeypatch):
    def crash(*_, **__):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(manifest, "put_if_absent", crash)
        with pytest.raises(OSError, match="gone"):
            managed.compact(spark, folder, POLICY, "2024-02-01 00:00:00")
    assert len(wals(folder)) == 5 and sequences(managed.read(spark, folder)) == list(range(1, 41)) and manifest.newest(folder) == 1
    assert managed.clean(folder, before=0) == [] and len(managed.clean(folder)) == 1 and len(wals(folder)) == 4


def test_commits_that_meet(spark, folder):
    base = manifest.load(folder)
    first, second = base.ordered()[0]["name"], base.ordered()[1]["name"]
    managed.append(events(spark, 41, 10), folder)
    state = manifest.commit(folder, [{"remove": first}], base, kind="compact")  # what came between only added: tried again behind it
    assert state.generation == 3 and len(state.segments) == 4
    with pytest.raises(manifest.Conflict):
        manifest.commit(folder, [{"remove": first}], base, kind="compact")
    managed.mark_deleted(spark, folder, spark.createDataFrame([(12,)], "sequence long"))
    with pytest.raises(manifest.Conflict):
        manifest.commit(folder, [{"remove": second}], base, kind="compact")
    with pytest.raises(ValueError, match="not above"):
        managed.append(events(spark, 45, 10), folder)
    assert manifest.newest(folder) == 4


def test_many_writers_take_numbers_one_by_one(tmp_path):
    path, done = str(tmp_path), []
    entry = lambda k: {"name": f"s{k}", "segment": k, "records": 1, "size": 9, "first_sequence": k, "last_sequence": k, "last_hash": "", "vector": None, "deleted": 0, "deleted_bytes": 0}

    def write(k):
        done.append(manifest.commit(path, [{"add": entry(k)}], manifest.State(), kind="compact", tries=100).generation)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(25)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    state = manifest.load(path)
    assert sorted(done) == list(range(1, 26)) and len(state.segments) == 25 and all(h["valid"] for h in manifest.history(path))
    assert manifest.load(path, 13).generation == 13 and len(manifest.load(path, 13).segments) == 13
    seal = manifest.NO_SEAL
    for e in state.ordered():
        seal = manifest.seal_of(seal, e)
        assert e["seal"] == seal
    assert not [f for f in os.listdir(f"{path}/_manifest") if f.startswith("_")]


def test_epochs_are_written_once(spark, folder):
    more = events(spark, 41, 5)
    assert managed.append(more, folder, stream="s", epoch=0).generation == 2
    assert managed.append(more, folder, stream="s", epoch=0).generation == 2 and len(sequences(managed.read(spark, folder))) == 45


def test_vacuum_keep_and_find(spark, folder):
    managed.mark_deleted(spark, folder, spark.createDataFrame([(k,) for k in (11, 12, 21)], "sequence long"))
    state = managed.vacuum(spark, folder, 0.2)
    assert [(e["records"], e["deleted"]) for e in state.ordered()] == [(10, 0), (8, 0), (10, 1), (10, 0)]
    assert managed.find(spark, folder, 13).first()["event_data"] == b"event 13" and managed.find(spark, folder, 12).count() == 0
    state = managed.keep_newest(spark, folder, 2)
    assert sequences(managed.read(spark, folder)) == list(range(21, 41)) and managed.report(spark, folder).first()["valid"]
    assert len(managed.clean(folder, keep=1, archive="old")) == 4 and len(wals(f"{folder}/old")) == 3


def test_sequences_of_a_table(spark, tmp_path):
    path = str(tmp_path / "log")
    ev = events(spark, 1, 30).select("ts", "event_data", "flags")
    managed.append(managed.numbered(ev, path), path, segment_bytes=900)
    managed.append(managed.numbered(ev, path), path, segment_bytes=900)
    rows = managed.read(spark, path).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, 61)) and [r["event_data"] for r in rows] == [f"event {k}".encode() for k in range(1, 31)] * 2
    assert len(manifest.load(path).segments) > 4 and managed.report(spark, path).first()["valid"]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    assert managed.segments(spark, path).count() == 0 and manifest.newest(path) is None
    managed.append(events(spark).where("false"), path)
    assert manifest.newest(path) == 1 and managed.read(spark, path).count() == 0 and managed.report(spark, path).first()["valid"]


@pytest.mark.parametrize("mode", ["SKIP", "STOP_AT_ERROR"])
def test_files_are_walked_in_blocks(mode):
    raw = b"".join(records.encode(k, k, bytes([k % 251]) * (k * 37 % 400)) for k in range(1, 120))
    rows = list(records.split(raw))
    bad = bytearray(raw)
    bad[rows[60].offset + 62] ^= 1
    for data in (raw, bytes(bad), raw[:-5], b"x" * 100 + raw):
        read_at = lambda n, at, data=data: data[at : at + n]
        for step in (1, 500, 4096, 1 << 20):
            assert list(records.ended(read_at, len(data), mode, 500, step)) == list(records.split(data, mode, 500))


def test_headers_by_seeking():
    sizes = [10, 5000, 3, 100_000, 70_000, 1]
    raw = b"".join(records.encode(k, k, b"z" * n) for k, n in enumerate(sizes, 1))
    read = []

    def read_at(n, at, data=raw):
        read.append(len(data[at : at + n]))
        return data[at : at + n]

    rows = list(records.walked(read_at, len(raw), block=1024))
    assert [r.sequence for r in rows] == list(range(1, 7)) and [r.offset for r in rows] == [r.offset for r in records.split(raw)]
    assert sum(read) < 7000 < len(raw)  # what long records hold stays where it is
    bad = bytearray(raw)
    bad[rows[2].offset + 5] ^= 1
    got = list(records.walked(lambda n, at: bytes(bad[at : at + n]), len(bad), block=1024))
    assert [getattr(r, "sequence", r[-1]) for r in got] == [1, 2, "header checksum", 4, 5, 6] and got[2].offset == rows[2].offset and got[2].size == rows[2].size
    assert list(records.walked(lambda n, at: raw[at : at + n], len(raw) - 3, block=1024))[-1].error == "short"


def test_commands_on_a_managed_log(spark, folder, capsys):
    import json

    from auditarium import cli

    managed.mark_deleted(spark, folder, spark.createDataFrame([(k,) for k in range(1, 10)], "sequence long"))
    assert cli.main(["vacuum", "--wal", folder], spark) == 0
    assert json.loads(capsys.readouterr().out)["generation"] == 3 and sequences(managed.read(spark, folder)) == list(range(10, 41))
    assert cli.main(["compact", "--wal", folder, "--threshold", "1.0"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["seal"] == manifest.load(folder).seal and sequences(managed.read(spark, folder)) == list(range(10, 41))
    assert cli.main(["verify", "--wal", folder, "--seal", out["seal"]], spark) == 0


def test_an_array_over_all_parts(spark, tmp_path):
    import json

    from auditarium.sources import export

    df = spark.createDataFrame([(k, f'text "{k}"', None if k % 3 else 1.5) for k in range(200)], "sequence long, m string, v double").repartition(7)
    for pretty in (False, True):
        path = tmp_path / f"a{pretty}"
        export.export_array(df, str(path), pretty=pretty)
        text = "".join(f.read_text() for f in sorted(path.glob("part-*")))
        assert [r["sequence"] for r in json.loads(text)] == list(range(200)) and ("\n  " in text) == pretty
