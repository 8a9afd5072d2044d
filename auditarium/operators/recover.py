"""Recovery of damaged logs: what can be read, what was lost, and repaired logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditarium.functions.model import NO_HASH
from auditarium.sources import records
from auditarium.sources.wal import read_log, store_of


def recover(spark: SparkSession, path: str, max_record_size: int = records.MAX_PAYLOAD) -> DataFrame:
    """All records that hold, and rows with parse_error for what lies between them (damaged tails, too)."""
    return read_log(spark, path, "RESYNC", max_record_size=max_record_size)


def report(rec: DataFrame, *keys: str) -> DataFrame:
    """Recovered and damaged runs, bytes skipped, and the last good sequence; one row, or one for each of keys (e.g. path)."""
    good = F.col("parse_error").isNull()
    return rec.groupBy(*keys).agg(F.count_if(good).alias("recovered"), F.count_if(~good).alias("corrupted"), F.coalesce(F.sum(F.when(~good, F.col("size"))), F.lit(0)).cast("long").alias("bytes_skipped"), F.max(F.when(good, F.col("sequence"))).alias("last_good_sequence"))


def repaired(rec: DataFrame) -> DataFrame:
    """Good records as events to be written again: numbered from 1 through all files in order, flags cleared, ready for write_log (which chains them)."""
    good = rec.where("parse_error is null")
    counts = good.groupBy("path").agg(F.count("*").alias("n"))  # one row a file
    ahead = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("ahead"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("segment"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("offset"))
    return good.withColumn("place", place).join(ahead, "path").select((F.col("ahead") + F.col("place")).alias("sequence"), F.timestamp_micros(F.expr("ts_nanos div 1000")).alias("ts"), "event_data", F.lit(0).alias("flags"), "segment", "path")


def plausible(rec: DataFrame, as_of: str) -> DataFrame:
    """Records of a likely time (ten years back to a day ahead), with known flags and a JSON payload."""
    at = F.timestamp_micros(F.expr("ts_nanos div 1000"))
    now = F.lit(as_of).cast("timestamp")
    return rec.where(at.between(now - F.expr("interval 10 years"), now + F.expr("interval 1 day")) & F.col("flags").isin(0, 1, 2, 3) & F.try_parse_json(F.col("event_data").cast("string")).isNotNull())


def salvage(spark: SparkSession, path: str, max_bytes: int = records.MAX_PAYLOAD) -> DataFrame:
    """A forensic pass over damaged runs: records of which one bit is wrong (kind header, payload or footer, by where it is), and runs of balanced braces (json). Rows path, offset, kind, data.

    Damaged runs are found by recover and read again by their place, each independently."""
    runs = recover(spark, path, max_bytes).where("parse_error is not null").select("path", "offset", "size")

    return _read(runs, path, lambda data: list(records.salvaged(data, max_bytes))).dropDuplicates(["path", "offset"])


def _read(runs: DataFrame, path: str, found) -> DataFrame:
    """path, offset, kind, data of what found (of a run's bytes: place, kind, data) gives for runs path, offset, size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(path)
        for batch in batches:
            out = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
                with store.open_input_file(file) as handle:
                    handle.seek(at)
                    data = handle.read(size)
                out += [(file, at + k, kind, piece) for k, kind, piece in found(data)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["path", "offset", "kind", "data"])

    return runs.select("path", "offset", "size").mapInArrow(each, "path string, offset long, kind string, data binary")


def chain_map(rec: DataFrame) -> DataFrame:
    """sequence, hash of every record that holds: what later records may name as the one before them. chains.branches puts them together."""
    return rec.where("parse_error is null").select("sequence", "hash").distinct()


def broken_links(rec: DataFrame) -> DataFrame:
    """path, offset, sequence, prev_hash, kind of records whose previous hash isn't that of the record before them in their file: start (none: a chain
    begins), fork (the hash of another record that holds: records were reordered, or written twice from there), near (the first eight bytes are those of the record before),
    or lost (the record it names is gone)."""
    good = rec.where("parse_error is null").select("path", "offset", "sequence", "prev_hash", "hash")
    before = F.lag("hash").over(Window.partitionBy("path").orderBy("offset"))
    broken = good.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("prev_hash")))
    known = good.select(F.col("hash").alias("prev_hash"), F.lit(True).alias("known")).distinct()
    kind = F.when(F.col("prev_hash") == NO_HASH, "start").when(F.col("known"), "fork").when(F.left("before", F.lit(16)) == F.left("prev_hash", F.lit(16)), "near").otherwise("lost")
    return broken.join(known, "prev_hash", "left").select("path", "offset", "sequence", "prev_hash", kind.alias("kind"))


def tails(spark: SparkSession, path: str, max_bytes: int = records.MAX_PAYLOAD) -> DataFrame:
    """path, offset, data: what the last record of a file holds whose header is whole but whose end is missing."""
    ends = recover(spark, path, max_bytes).groupBy("path").agg(F.max_by(F.struct("offset", "size", "parse_error"), "offset").alias("last")).where("last.parse_error is not null").select("path", "last.offset", "last.size")

    def found(data: bytes) -> list[tuple[int, str, bytes]]:
        piece = records.partial(data, max_bytes)
        return [] if piece is None else [(piece[0], "tail", piece[1])]

    return _read(ends, path, found).select("path", "offset", "data")


def forensic(spark: SparkSession, path: str, shadow: str | None = None, max_bytes: int = records.MAX_PAYLOAD) -> DataFrame:
    """method, path, offset, data of all that can be had: records that hold (standard), damaged runs' records with one wrong bit and JSON (header, payload, footer, json), truncated ends (tail), and
    records of a shadow log that the log lacks (shadow)."""
    rec = recover(spark, path, max_bytes)
    out = rec.where("parse_error is null").select(F.lit("standard").alias("method"), "path", "offset", F.col("event_data").alias("data"))
    out = out.unionByName(salvage(spark, path, max_bytes).select(F.col("kind").alias("method"), "path", "offset", "data"))
    out = out.unionByName(tails(spark, path, max_bytes).select(F.lit("tail").alias("method"), "path", "offset", "data"))
    if shadow:
        more = recover(spark, shadow, max_bytes).where("parse_error is null").join(chain_map(rec).select("hash"), "hash", "left_anti")
        out = out.unionByName(more.select(F.lit("shadow").alias("method"), "path", "offset", F.col("event_data").alias("data")))
    return out


def forensic_report(found: DataFrame) -> DataFrame:
    """One row for each method: pieces and bytes."""
    return found.groupBy("method").agg(F.count("*").alias("pieces"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))
