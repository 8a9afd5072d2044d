"""Chains put together from hashes alone, against a walk in plain Python: forks, lost records, any order, repeated records."""

import hashlib
import os
import random

import pytest

from auditarium.functions.model import NO_HASH
from auditarium.operators import chains

SCHEMA = "path string, offset long, sequence long, hash string, prev_hash string"


def name(*x):
    return hashlib.sha256(repr(x).encode()).hexdigest()


def forest(rng, n, forks, lose):
    """Records (sequence, hash, prev_hash) of a chain with branches at random places, without some."""
    rows, ends = [], [(0, NO_HASH)]
    for b in range(forks + 1):
        sequence, prev = rng.choice(ends) if b else ends[0]
        for _ in range(n if not b else rng.randint(1, n // 2)):
            sequence += 1
            own = name(b, sequence, rng.random())
            rows.append((sequence, own, prev))
            prev = own
            ends.append((sequence, own))
    gone = set(rng.sample(range(len(rows)), lose))
    return [r for k, r in enumerate(rows) if k not in gone]


def brute(rows):
    by_hash, children = {h: (s, p) for s, h, p in rows}, {}
    for s, h, p in rows:
        children.setdefault(p, []).append(h)
    best, out = {}, []
    for _, h, _ in sorted(rows, reverse=True):
        found = [(-best[c][0], best[c][1]) for c in children.get(h, ())]
        depth, tip = min(found) if found else (0, h)
        best[h] = (1 - depth if found else 1, tip)

    def run_of(h):
        return h

    for s, h, p in rows:
        if p in by_hash and best[p][1] == best[h][1]:
            continue  # goes on
        n, end, at = 1, h, h
        while any(best[c][1] == best[h][1] for c in children.get(at, ())):
            at = next(c for c in children[at] if best[c][1] == best[h][1])
            n, end = n + 1, at
        top = h
        while by_hash[top][1] in by_hash:
            top = by_hash[top][1]
        out.append((top, "start" if by_hash[top][1] == NO_HASH else "lost", p not in by_hash, s, by_hash[end][0], n, end, by_hash[p][0] if p in by_hash else None, p))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "files", "forks", "lose"), [(1, 1, 0, 0), (2, 4, 3, 2), (3, 40, 5, 6), (4, 400, 8, 10)])
def test_branches(spark, seed, files, forks, lose):
    rng = random.Random(seed)
    rows = forest(rng, 120, forks, lose)
    want = brute(rows)
    placed = []
    if files < 40:  # records stand as they were written, in a few files
        size = -(-len(rows) // files)
        placed = [(f"f{k // size:03d}", k % size * 10, *r) for k, r in enumerate(rows)]
    else:
        placed = [(f"f{rng.randrange(files):03d}", rng.randrange(10**6), *r) for r in rows]
    placed += [("again", 5, *rows[3]), ("again", 6, *rows[4])]
    df = spark.createDataFrame(placed, SCHEMA).repartition(3)
    got = sorted(map(tuple, chains.branches(df).collect()), key=str)
    assert got == want


def test_runs_are_few(spark):
    rows = forest(random.Random(9), 500, 0, 0)
    df = spark.createDataFrame([(f"f{k // 100}", k, *r) for k, r in enumerate(rows)], SCHEMA)
    assert chains.runs(df).count() == 5 and chains.ranked(chains.runs(df)).where("above = 400 and depth = 100").count() == 1


def test_lost_and_empty(spark):
    rows = [r for r in forest(random.Random(9), 30, 0, 0) if r[0] not in (10, 11, 20)]
    df = spark.createDataFrame([("f", k, *r) for k, r in enumerate(rows)], SCHEMA)
    found = chains.lost(chains.branches(df)).orderBy("sequence").collect()
    assert [(r["sequence"], r["records"], r["branches"]) for r in found] == [(12, 8, 1), (21, 10, 1)] and found[0]["missing"] == rows[9][2]
    assert chains.branches(df.where("false")).count() == 0


@pytest.fixture
def small(spark, monkeypatch):
    """Few records lie together, and fewer are seen at once."""
    monkeypatch.setattr(chains, "SPAN", 16)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize(("seed", "order"), [(5, "scattered"), (6, "scattered"), (7, "permuted"), (8, "backwards"), (9, "equal")])
def test_branches_of_records_that_lie_apart(spark, small, seed, order):
    """Chains go through many batches; sequences may tell nothing of a record's place."""
    rng = random.Random(seed)
    rows = forest(rng, 60, 6, 4)
    want = brute(rows)
    numbers = sorted({r[0] for r in rows})
    other = {"scattered": numbers, "permuted": rng.sample(numbers, len(numbers)), "backwards": numbers[::-1], "equal": [3] * len(numbers)}[order]
    number = dict(zip(numbers, other, strict=True)) | {None: None}
    want = sorted(((*r[:3], number[r[3]], number[r[4]], *r[5:7], number[r[7]], r[8]) for r in want), key=str)
    again = [rows[k] for k in (0, 7, 8, 30, len(rows) - 1)]
    again += [(s + 1000, h, p) for s, h, p in again] if order == "scattered" else []  # found with later numbers, too
    placed = [(f"f{rng.randrange(9)}", k, number.get(s, s), h, p) for k, (s, h, p) in enumerate(rows + again)]
    rng.shuffle(placed)
    assert sorted(map(tuple, chains.branches(spark.createDataFrame(placed, SCHEMA).repartition(5)).collect()), key=str) == want


def test_names_of_any_form(spark):
    names = ["", "ab", "x" * 32, "\xff" * 16, "AB" * 32, "ab" * 32, "z" * 64, "f" * 63]
    df = spark.createDataFrame([(f"f{k % 3}", k, k + 1, h, p) for k, (h, p) in enumerate(zip(names, [NO_HASH, *names], strict=False))], SCHEMA)
    assert [tuple(r) for r in chains.branches(df).collect()] == [(names[0], "start", True, 1, len(names), len(names), names[-1], None, NO_HASH)]


def test_scattered_records_are_stored_once(spark):
    """What is stored grows with the records, by 32 bytes each and a little, however they lie: not by rounds over all of them."""
    n, folder = 4000, spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names if x.startswith("part-"))
    rng = random.Random(3)
    df = spark.createDataFrame([(f"f{rng.randrange(13)}", rng.randrange(10**9), *r) for r in forest(rng, n, 0, 0)], SCHEMA)
    before = held()
    assert [r["records"] for r in chains.branches(df).collect()] == [n]
    assert held() - before < 64 * n + 100_000
