"""Maintenance: which segments to compact, how to group them, and what compacting, vacuuming and tombstones leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import FLAG_DELETED, CompactionPolicy


def eligible(seg: DataFrame, policy: CompactionPolicy, as_of: str) -> DataFrame:
    """Sealed segments of enough age that are small or have a low live ratio. seg: sealed, created_at, size, ratio."""
    old = F.col("created_at") <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {policy.max_age_hours} hours")
    return seg.where(F.col("sealed") & old & ((F.col("size") < policy.min_segment_size) | (F.col("ratio") < policy.ratio)))


def pack(seg: DataFrame, policy: CompactionPolicy) -> DataFrame:
    """Groups of neighbouring segments up to the target size, in order; the last one only if it has enough segments or bytes.

    Greedy filling needs the segments in order: one row for each file of some 64 MiB, not records. They pass through one task as a stream that keeps
    two numbers; logs of one key are each on their own if seg has a column log."""
    keyed = "log" in seg.columns
    rows = seg.select(*(["log"] if keyed else [F.lit(0).alias("log")]), "start_seq", F.col("segment").cast("long").alias("segment"), F.col("size").cast("long").alias("size"))
    kind = rows.schema["log"].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, group, held = None, 0, 0
        for batch in batches:
            numbers = []
            for own, size in zip(batch.column("log").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if own != log:
                    log, group, held = own, 0, 0
                elif held + size > policy.target_size:
                    group, held = group + 1, 0
                held += size
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("start_seq").cast(pa.int64()), batch.column("segment"), batch.column("size"), pa.array(numbers, pa.int32())], names=["log", "start_seq", "segment", "size", "group_no"])

    dealt = rows.repartition("log") if keyed else rows.coalesce(1)
    groups = dealt.sortWithinPartitions("log", "start_seq", "segment").mapInArrow(numbered, f"log {kind}, start_seq long, segment long, size long, group_no int")
    groups = groups.groupBy("log", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_seq", "segment"))), lambda x: x["segment"]).alias("segments"), F.sum("size").alias("bytes"), F.count("*").cast("int").alias("n"))
    last = groups.groupBy("log").agg(F.max("group_no").alias("last"))
    kept = groups.join(last, "log").where((F.col("group_no") < F.col("last")) | (F.col("n") >= policy.min_segments) | (F.col("bytes") >= policy.min_segment_size))
    return kept.select(*(["log"] if keyed else []), "group_no", "segments", "bytes", "n")


def compacted(ev: DataFrame) -> DataFrame:
    """What compaction leaves: of each sequence the first record, deleted ones dropped. Superseded records stay: an audit log loses none."""
    first = F.row_number().over(Window.partitionBy("sequence").orderBy("segment", "copy" if "copy" in ev.columns else "ts"))
    return ev.withColumn("__n", first).where("__n = 1").drop("__n").where(F.col("flags").bitwiseAND(FLAG_DELETED) == 0)


def compact_range(ev: DataFrame, seg: DataFrame, first: int, last: int) -> DataFrame:
    """ev with the segments that overlap the sequences first to last made one (the least of their numbers) by compaction; others, and a single one, stay as they are."""
    inside = seg.where((F.col("end_seq") >= first) & (F.col("start_seq") <= last)).select("segment")
    one = inside.agg(F.min("segment").alias("__into"), F.count("*").alias("__n"))
    marked = ev.join(inside.withColumn("__in", F.lit(True)), "segment", "left").crossJoin(F.broadcast(one)).withColumn("__in", F.coalesce("__in", F.lit(False)) & (F.col("__n") > 1))
    merged = compacted(marked.where("__in")).withColumn("segment", F.col("__into"))
    return merged.select(ev.columns).union(marked.where("not __in").select(ev.columns))


def compact_cycle(ev: DataFrame, seg: DataFrame, policy: CompactionPolicy, as_of: str) -> DataFrame:
    """ev after one cycle: eligible segments (seg: sealed, created_at, size, ratio, start_seq) are grouped to the target size, and each group becomes one compacted
    segment with the number of its first; other segments stay as they are."""
    groups = pack(eligible(seg, policy, as_of), policy)
    into = groups.select(F.explode("segments").alias("segment"), F.element_at("segments", 1).alias("__into"))
    marked = ev.join(into, "segment", "left")
    merged = compacted(marked.where("__into is not null")).withColumn("segment", F.col("__into").cast(ev.schema["segment"].dataType))
    return merged.select(ev.columns).union(marked.where("__into is null").select(ev.columns))


def vacuumed(ev: DataFrame, seg: DataFrame, share: float = 0.1) -> DataFrame:
    """ev without the deleted records of sealed segments of which at least a share is deleted. Sequences and other records stay."""
    chosen = vacuum_candidates(seg.where("sealed"), share).select("segment", F.lit(True).alias("__hit"))
    return ev.join(chosen, "segment", "left").where(F.col("__hit").isNull() | (F.col("flags").bitwiseAND(FLAG_DELETED) == 0)).select(ev.columns)


def vacuum_candidates(seg: DataFrame, share: float = 0.1) -> DataFrame:
    """Segments of whose records at least a share is deleted; empty ones are none."""
    return seg.where((F.col("record_count") > 0) & (F.col("deleted") / F.col("record_count") >= share))


def tombstoned(ev: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ev without the records that tombstones (deleted_sequence) name."""
    return ev.join(tombstones.select(F.col("deleted_sequence").alias("sequence")).distinct(), "sequence", "left_anti")


def mark_deleted(ev: DataFrame, sequences: DataFrame) -> DataFrame:
    """ev with the deleted flag set where sequences names the record. Bytes stay as they are, so chains stay whole."""
    named = sequences.select("sequence", F.lit(True).alias("__hit")).distinct()
    return ev.join(named, "sequence", "left").withColumn("flags", F.when(F.col("__hit"), F.col("flags").bitwiseOR(FLAG_DELETED)).otherwise(F.col("flags"))).drop("__hit")


def newest(seg: DataFrame, n: int = 1000) -> DataFrame:
    """The segments to keep: the n newest, and all that aren't sealed. A top-n (each task sends n rows at most), not a sort of all."""
    top = seg.orderBy(F.desc("created_at"), F.desc("segment")).limit(n)
    return top.unionByName(seg.where(~F.col("sealed")).join(top.select("segment"), "segment", "left_anti"))


def dry_run(ev: DataFrame, seg: DataFrame, ratios: DataFrame, policy: CompactionPolicy, as_of: str) -> DataFrame:
    """What compaction would do: for each eligible segment its ratio and the bytes it would free."""
    rows = seg.join(ratios.select("segment", "ratio", "superseded"), "segment")
    return eligible(rows, policy, as_of).withColumn("gain", F.floor(F.col("size") * (1 - F.col("ratio"))).cast("long"))
