"""Legal holds over ranges of time: what must be kept although its time is over.

A hold names a key (an entity; null: all) and a range of times. Events meet holds by buckets of time, then exactly, so no event is compared with all holds; a key that is hot, or a hold
without a key, is spread over the buckets of its range. A hold longer than `MOST` buckets would be that many rows: it gets coarser buckets, a level for each power of `BASE`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR, BASE, MOST, LEVELS = 3600, 16, 64, 7


def _seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def held(ev: DataFrame, holds: DataFrame) -> DataFrame:
    """sequence, hold_id: events (sequence, ts, entity_id) that a hold (hold_id, entity_id or null, start, end; both inclusive, an open end is null) covers; once for each such hold. Holds
    that end before they begin cover nothing."""
    until = F.coalesce(F.col("end"), F.lit("9999-12-31 23:59:59").cast("timestamp_ntz"))
    rows = holds.select("hold_id", F.col("entity_id").alias("of"), F.col("start").alias("low"), until.alias("high")).where("low <= high")
    rows = rows.withColumn("a", _seconds("low")).withColumn("b", _seconds("high"))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when((F.col("b") - F.col("a")) / (HOUR * BASE**k) < MOST, k).otherwise(level)
    width = HOUR * F.pow(F.lit(BASE), F.col("level")).cast("long")
    rows = rows.withColumn("level", level).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width)))).drop("a", "b")
    used = [r["level"] for r in rows.select("level").distinct().collect()]  # at most LEVELS
    at = _seconds("ts")
    parts = ev.select("sequence", "ts", "entity_id").withColumn("place", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(at / (HOUR * BASE**k)).alias("bucket")) for k in used)))) if used else None
    if parts is None:
        return ev.select("sequence", F.lit(None).cast(holds.schema["hold_id"].dataType).alias("hold_id")).where("false")
    parts = parts.select("sequence", "ts", "entity_id", "place.level", "place.bucket")
    inside = F.col("ts").between(F.col("low"), F.col("high"))
    keyed = parts.join(rows.where("of is not null"), (parts["level"] == rows["level"]) & (parts["bucket"] == rows["bucket"]) & (parts["entity_id"] == rows["of"])).where(inside).select("sequence", "hold_id")
    general = rows.where("of is null").select(F.col("level").alias("l"), F.col("bucket").alias("b"), "low", "high", "hold_id")
    every = parts.join(general, (parts["level"] == general["l"]) & (parts["bucket"] == general["b"])).where(inside).select("sequence", "hold_id")
    return keyed.unionByName(every)


def disposable(ev: DataFrame, holds: DataFrame, cutoff: str) -> DataFrame:
    """Events before a retention cutoff that no hold covers."""
    old = ev.where(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"))
    return old.join(held(old, holds).select("sequence").distinct(), "sequence", "left_anti")
