"""Block matching against byte comparison, and holds against a walk over all pairs."""

import os
import random
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest

from auditarium.operators import blocks, holds


def rebuilt(runs, data, shadow):
    """What the runs say of a file must be so, and cover it."""
    at = 0
    for kind, start, end, there in runs:
        assert start == at and end > start
        if kind in ("same", "moved"):
            assert data[start:end] == shadow[there : there + end - start] and (kind == "same") == (there == start)
        at = end
    assert at == len(data)


def run(data, shadow, block=64, piece=1024):
    at = lambda x: lambda n, k: x[k : k + n]
    runs = list(blocks.matched(at(data), len(data), at(shadow), len(shadow), block, piece))
    rebuilt(runs, data, shadow)
    return [r[0] for r in runs], sum(r[2] - r[1] for r in runs if r[0] == "changed")


def test_matching():
    rng = random.Random(1)
    for size in (0, 1, 63, 64, 65, 1000, 5000, 20_001):
        shadow = rng.randbytes(size)
        assert run(shadow, shadow) == (["same"] if size else [], 0)
        if size < 1000:
            continue
        at = rng.randrange(100, size - 200)
        kinds, changed = run(shadow[:at] + b"!" + shadow[at + 1 :], shadow)
        assert kinds == ["same", "changed", "same"] or shadow[at] == 33
        assert changed <= 64
        kinds, changed = run(shadow[:at] + b"put in here" + shadow[at:], shadow)
        assert kinds == ["same", "changed", "moved"] and changed <= 64 + 11
        kinds, changed = run(shadow[: at - 30] + shadow[at:], shadow)
        assert kinds[-1] == "moved" and changed <= 128
        assert run(shadow[: size // 2], shadow)[1] < 64 and run(b"?" * size, shadow)[1] == size
        run(shadow[size // 2 :] + shadow[: size // 2], shadow)


def test_weak_sums_roll():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    got = blocks.weak_sums(data, 40)
    for k in (0, 1, 77, 460):
        part = data[k : k + 40].astype(int)
        assert got[k] == (part.sum() & 0xFFFF) | ((int((part * np.arange(40, 0, -1)).sum()) & 0xFFFF) << 16)


def test_folders(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    os.makedirs(a)
    rng = random.Random(3)
    for k in range(3):
        open(f"{a}/{k}.wal", "wb").write(rng.randbytes(10_000))
    shutil.copytree(a, b)
    os.rename(f"{b}/2.wal", f"{b}/3.wal")
    data = bytearray(open(f"{a}/1.wal", "rb").read())
    data[5000] ^= 1
    open(f"{a}/1.wal", "wb").write(data)
    rows = sorted((r["name"], r["start"], r["end"], r["kind"]) for r in blocks.differences(spark, a, b, 1000).collect())
    assert rows == [("0.wal", 0, 10_000, "same"), ("1.wal", 0, 5000, "same"), ("1.wal", 5000, 6000, "changed"), ("1.wal", 6000, 10_000, "same"), ("2.wal", 0, 10_000, "extra"), ("3.wal", 0, 10_000, "missing")]


@pytest.mark.parametrize("seed", [1, 2])
def test_holds(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2020, 1, 1)
    ev = [(k, t0 + timedelta(seconds=rng.randrange(4 * 365 * 86400)), rng.choice(("hot", "hot", "a", "b", None))) for k in range(400)]
    hold = []
    for k in range(60):
        start = t0 + timedelta(seconds=rng.randrange(4 * 365 * 86400))
        hold.append((k, rng.choice(("hot", "a", "none", None)), start, rng.choice((start, start + timedelta(minutes=5), start + timedelta(days=rng.randrange(900)), start - timedelta(days=1), None))))
    hold.append((99, ev[0][2], ev[0][1], ev[0][1]))
    want = sorted((s, h) for s, ts, e in ev for h, of, low, high in hold if (of is None or of == e) and low <= ts and (high is None or ts <= high))
    if ev[0][2] is None:
        want = sorted(set(want))
    e = spark.createDataFrame(ev, "sequence long, ts timestamp_ntz, entity_id string")
    h = spark.createDataFrame(hold, "hold_id long, entity_id string, start timestamp_ntz, end timestamp_ntz")
    assert sorted(map(tuple, holds.held(e, h).collect())) == want
    kept = {s for s, _ in want}
    assert sorted(r["sequence"] for r in holds.disposable(e, h, "2022-01-01 00:00:00").collect()) == sorted(s for s, ts, _ in ev if ts < datetime(2022, 1, 1) and s not in kept)
    assert holds.held(e, h.where("false")).count() == 0
    plan = holds.held(e, h)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
