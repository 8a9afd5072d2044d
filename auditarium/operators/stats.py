"""Statistics of logs and segments: single aggregates with partial sums, and windows by segment only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import DEBUG, ERROR, FLAG_DELETED, INFORMATION, WARNING, format_bytes

IDEAL = 64 << 20


def level_counts(ev: DataFrame, *keys: str) -> DataFrame:
    level = F.col("level")
    return ev.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(level >= ERROR).alias("errors"), F.count_if(level == WARNING).alias("warnings"),
        F.count_if(level == INFORMATION).alias("infos"), F.count_if(level <= DEBUG).alias("debugs"),
    )


def log_stats(ev: DataFrame, catalog: DataFrame | None = None, ideal: int = IDEAL) -> DataFrame:
    """One row for a whole log, from one scan: aggregates of segments are aggregated. catalog (path, created_at, size, sealed, damaged: one row a segment file)
    adds when the log was created and last grew, whether its last file is sealed, and whether any is damaged."""
    level, sums = F.col("level"), ("total", "errors", "warnings", "infos", "debugs", "bytes")
    by_segment = ev.groupBy("segment").agg(
        F.count("*").alias("total"), F.count_if(level >= ERROR).alias("errors"), F.count_if(level == WARNING).alias("warnings"), F.count_if(level == INFORMATION).alias("infos"), F.count_if(level <= DEBUG).alias("debugs"),
        F.sum("size").alias("bytes"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.min_by("ts", "sequence").alias("first_time"), F.max_by("ts", "sequence").alias("last_time"),
    )
    row = by_segment.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) if c != "bytes" else F.sum(c).alias(c) for c in sums), F.min_by("first_time", "first_seq").alias("first_time"), F.max_by("last_time", "last_seq").alias("last_time"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.count("*").alias("segments"),
    )
    row = row.select(
        "total", "errors", "warnings", "infos", "debugs", "first_time", "last_time", "first_seq", "last_seq", "segments", "bytes", F.expr("bytes div nullif(total, 0)").alias("avg_record"), F.expr("bytes div nullif(segments, 0)").alias("avg_segment"),
        F.round(F.greatest(F.lit(0.0), (F.col("segments") - F.expr(f"bytes div {ideal} + 1")) / F.expr(f"bytes div {ideal} + 1") * 100.0), 6).alias("fragmentation"),
        (F.unix_micros(F.col("last_time").cast("timestamp")) - F.unix_micros(F.col("first_time").cast("timestamp"))).alias("duration_micros"),
    )
    if catalog is None:
        return row
    files = catalog.agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("modified_at"), F.coalesce(F.max_by("sealed", F.struct("created_at", "path")), F.lit(False)).alias("is_sealed"), F.coalesce(F.bool_or("damaged"), F.lit(False)).alias("has_corruption"), F.count("*").alias("files"))
    return row.crossJoin(F.broadcast(files))


def segment_stats(seg: DataFrame, ideal: int = IDEAL) -> DataFrame:
    """Each segment's records by its sequences, its share of the ideal size if sealed, and its size as text. seg: with sealed."""
    n = F.when(F.col("end_seq") > F.col("start_seq"), F.col("end_seq") - F.col("start_seq") + 1).when((F.col("start_seq") > 0) & ~F.col("sealed"), -1).otherwise(0)
    return seg.select("segment", "start_seq", "end_seq", "size", "sealed", n.cast("long").alias("records"), F.when(F.col("sealed"), F.round(F.col("size") / float(ideal) * 100.0, 9)).otherwise(0.0).alias("compaction_pct"), format_bytes(F.col("size")).alias("size_text"))


def with_live(ev: DataFrame) -> DataFrame:
    """ev with superseded (a later live record of the same entity in its segment) and live. One shuffle, by segment and entity."""
    dead = F.col("flags").bitwiseAND(FLAG_DELETED) != 0
    last = F.max(F.when(~dead, F.col("sequence"))).over(Window.partitionBy("segment", "entity_id"))
    superseded = F.coalesce(F.col("sequence") < last, F.lit(False)) & F.col("entity_id").isNotNull()
    return ev.withColumn("deleted", dead).withColumn("superseded", ~dead & superseded).withColumn("live", ~dead & ~superseded)


def live_ratio(ev: DataFrame) -> DataFrame:
    """Bytes of live records by all bytes, of each segment, and the counts behind it."""
    return with_live(ev).groupBy("segment").agg(
        F.coalesce(F.round(F.sum(F.when(F.col("live"), F.col("size")).otherwise(0)) / F.sum("size"), 9), F.lit(1.0)).alias("ratio"),
        F.sum("size").alias("size"), F.count_if("deleted").alias("deleted"), F.count_if("superseded").alias("superseded"), F.count("*").alias("records"),
    )


def compaction_gain(ratios: DataFrame, below: float) -> DataFrame:
    """Bytes that compacting the segments with a live ratio under below would free."""
    return ratios.where(F.col("ratio") < below).agg(F.coalesce(F.sum(F.floor(F.col("size") * (1 - F.col("ratio")))), F.lit(0)).cast("long").alias("gain"), F.count("*").alias("segments"))
