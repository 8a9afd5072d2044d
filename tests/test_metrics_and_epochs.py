"""Metrics that add up, counters with resets, and keys by epoch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditarium.operators import compliance, metrics

T0 = datetime(2024, 1, 1)


def rows(spark, n=300):
    rng = random.Random(1)
    return spark.createDataFrame([(k, rng.choice((None, 0.0005, 0.001, 0.5, 40.0, rng.random())), rng.choice(("a", 'q"\\', None))) for k in range(n)], "k long, seconds double, backend string")


def test_parts_add_up(spark):
    df = rows(spark)
    whole = metrics.histogram(df, "latency", "seconds", ("backend",)).unionByName(metrics.counter(df, "writes", ("backend",)))
    parts = [metrics.histogram(df.where(f"k % 3 = {i}"), "latency", "seconds", ("backend",)).unionByName(metrics.counter(df.where(f"k % 3 = {i}"), "writes", ("backend",))) for i in range(3)]
    key = lambda d: sorted((r["metric"], r["labels"], str(r["le"]), r["n"], None if r["total"] is None else round(r["total"], 9)) for r in d.collect())
    assert key(metrics.merged(*parts)) == key(whole)
    assert {r["labels"] for r in whole.collect()} == {'backend=""', 'backend="a"', 'backend="q\\"\\\\"'}
    text = {r["line"] for r in metrics.lines(metrics.counter(df, "writes")).collect()}
    assert text == {"writes{} 300.0"}
    assert metrics.histogram(df.where("false"), "latency", "seconds").count() == 0


def test_a_stream_counts_like_a_batch(spark, tmp_path):
    df = rows(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = metrics.histogram(stream, "latency", "seconds", ("backend",)).writeStream.outputMode("complete").foreachBatch(lambda b, _: out.append(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda found: sorted((r["labels"], str(r["le"]), r["n"]) for r in found)
    assert len(out) == 3 and key(out[-1]) == key(metrics.histogram(df, "latency", "seconds", ("backend",)).collect())


def test_quantiles(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") / 1000.0)
    found = metrics.quantile(metrics.histogram(df, "m", "v"), 0.5).first()["value"]
    assert 0.48 < found < 0.53
    assert metrics.quantile(metrics.histogram(df.withColumn("v", F.lit(1e9)), "m", "v"), 0.9).first()["value"] == metrics.LATENCY[-1]


def test_counters_begin_anew(spark):
    readings = {"a": [5, 7, 7, 2, 3, 0, 10], "b": [1], "c": [100, 0]}
    df = spark.createDataFrame([(s, T0 + timedelta(minutes=25 * k), v) for s, vs in readings.items() for k, v in enumerate(vs)], "s string, at timestamp_ntz, v long")
    got = {(r["s"], r["start"]): r["increase"] for r in metrics.increase(df, "v", "at", "1 hour", "s").collect()}
    hour = lambda k: T0 + timedelta(hours=k)
    assert got == {("a", hour(0)): 2.0, ("a", hour(1)): 3.0, ("a", hour(2)): 10.0, ("b", hour(0)): 0.0, ("c", hour(0)): 0.0}


@pytest.mark.parametrize("every", [1, 7, 1000])
def test_keys_by_epoch(spark, every):
    ev = spark.createDataFrame([(k, k // 9, f"event {k}") for k in range(50)], "sequence long, segment long, event_data string").repartition(3)
    firsts = [e for e in (2, 3, 6) if every < 1000] or [0]
    keys = spark.createDataFrame([(e, bytes([e] * 32)) for e in firsts], "first_epoch long, key binary")
    found = compliance.protect_by_epoch(ev, keys, every).join(keys.select(F.substring(F.sha2("key", 256), 1, 16).alias("key_id"), "first_epoch"), "key_id", "left").collect()
    assert len(found) == 50
    for r in found:
        epoch = r["sequence"] // every
        want = max((e for e in firsts if e <= epoch), default=None)
        assert r["epoch"] == epoch and r["first_epoch"] == want and (r["sealed"] is None) == (want is None)
