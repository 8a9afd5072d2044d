"""Whitening against numpy over whole tables in exact arithmetic, and its edges."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from auditarium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def brute(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    sums = x.sum(0)
    n = len(x)
    centred = (n * x - sums).astype(np.float64) / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))) for row in x], centred, values[::-1], own[:, ::-1]


def check(rows, vectors, ids, most=32):
    n, deviations, centred, values, own = brute(vectors)
    k = min(most, len(values))
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == n * k
    for c in range(k):
        want = centred @ own[:, c] / math.sqrt(values[c])
        got = np.array([found[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(want @ got)
        assert np.abs(want * sign - got).max() < 1e-7
        for i, d in zip(ids, deviations, strict=True):
            r = found[i, c + 1]
            assert r["n"] == n and r["deviation"] == d and abs(r["explained"] - values[c] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9


def test_query(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    check(__spark_entry__.queries()["op12_whitening"](spark, sf).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_partitions_and_left_out_rows(spark, parts):
    rng = np.random.default_rng(parts)
    good = (rng.normal(size=(150, 5)) * [9, 4, 2, 1, 0.5] + [1000, -300, 0, 5, 70]).astype(np.float32).tolist()
    rows = [(k, v, "x") for k, v in enumerate(good)]
    bad = [(900, None, "x"), (901, [1.0, None, 2.0, 3.0, 4.0], "x"), (902, [math.nan] * 5, "x"), (903, [1.0, 2.0, math.inf, 3.0, 4.0], "x"), (904, [], "x")]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(parts)
    check(whitening.whitened(df).collect(), good, range(150))


def test_repeated_rows_null_ids_and_few_components(spark):
    v = [[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, 5.0]]
    df = spark.createDataFrame([(1, v[0], "a"), (1, v[1], "a"), (None, v[2], "b"), (3, v[3], "c")], SCHEMA)
    rows = whitening.whitened(df, 1).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == [("1", 1), ("1", 1), ("3", 1), ("None", 1)]
    assert len({(r["whitened"], r["deviation"]) for r in rows if r["vec_id"] == 1}) == 1


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([(k, [1.0, float(k), 2.0], "a") for k in range(4)] + [(9, [1.0, 2.0, 2.0], "a")], SCHEMA)
    rows = {(r["vec_id"], r["component"]): r for r in whitening.whitened(df).collect()}
    assert len(rows) == 15 and all(rows[k, c]["whitened"] is None and rows[k, c]["explained"] == 0 for k in (0, 9) for c in (2, 3))
    assert abs(rows[0, 1]["explained"] - 1) < 1e-12 and rows[0, 1]["identity_error"] < 1e-12
    one = whitening.whitened(df.limit(1)).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["n"]) for r in one] == [(c, None, 0, 1) for c in (1, 2, 3)]
    assert whitening.whitened(df.where("false")).count() == 0 and whitening.whitened(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_refused(spark):
    with pytest.raises(Exception, match="entries"):
        whitening.whitened(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], SCHEMA).repartition(2)).collect()
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened(spark.createDataFrame([(1, [1e30], "a"), (2, [1.0], "a")], SCHEMA)).collect()


def test_merging_keeps_precision():
    """Sums of squares of numbers near 10^12 lose the variance; merged summaries keep it, in any order of merging."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (3000, 4)) + 10**12
    want = np.cov(x - 10**12, rowvar=False, bias=True)
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 1), (1, 900), (900, 2999), (2999, 3000))]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = whitening.merged(left, p)
    for p in parts[-2::-1]:
        right = whitening.merged(p, right)
    for got in (left, right):
        assert got.n == 3000 and [int(s) for s in got.sums] == x.sum(0).tolist() and np.abs(got.scatter / 3000 - want).max() < 1e-10
