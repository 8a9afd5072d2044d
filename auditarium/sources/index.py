"""An index of records: where sequences and times stand in a log, so that looking up reads the bytes of what is found and no others.

A row stands for `every` records of a file that follow each other (1: each record): file, offset, bytes, records, first and last sequence and time, flags (or-ed), checksum (of the first record). It
is Parquet in ranges of sequences, sorted, so that footers and row groups tell which part of the index a lookup needs. Rows that a lookup finds become byte ranges, neighbours
joined over gaps of up to `GAP` bytes, and tasks read these ranges alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import manifest, records, wal

GAP, RANGE_BYTES = 64 << 10, 32 << 20


def build(spark: SparkSession, path: str, target: str, every: int = 1, parts: int | None = None, generation: int | None = None) -> DataFrame:
    """The index of a log (of a managed one, of a generation), written to target; the headers of all records are read, what long ones hold is not."""
    heads = wal.read_headers(spark, path, generation=generation)
    run = F.floor((F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1) / every)  # a window over a file's records
    rows = heads.withColumn("run", run).groupBy("path", "run").agg(
        F.min("offset").alias("offset"), F.sum(F.col("size").cast("long")).alias("bytes"), (F.max(F.col("offset") + F.col("size")) - F.min("offset")).alias("span"), F.count("*").alias("records"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
        F.min("ts_nanos").alias("first_nanos"), F.max("ts_nanos").alias("last_nanos"), F.bit_or("flags").alias("flags"), F.min_by("checksum", "offset").alias("checksum"),
    ).drop("run")
    dealt = rows.repartitionByRange(parts, "first_sequence") if parts else rows.repartitionByRange("first_sequence")
    dealt.sortWithinPartitions("first_sequence").write.mode("overwrite").parquet(target)
    return load(spark, target)


def load(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def entries(index: DataFrame, first: int | None = None, last: int | None = None, start_nanos: int | None = None, end_nanos: int | None = None) -> DataFrame:
    """Rows of the index that may hold sequences from first to last and times from start to end, all inclusive: plain comparisons, which reach the scan."""
    for column, low, high in (("sequence", first, last), ("nanos", start_nanos, end_nanos)):
        if low is not None:
            index = index.where(F.col(f"last_{column}") >= low)
        if high is not None:
            index = index.where(F.col(f"first_{column}") <= high)
    return index


def of_sequences(index: DataFrame, sequences: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Rows of the index that may hold any of sequences (a table, column sequence): rows and sequences meet by blocks of `width` sequences, then exactly. A row spans
    few blocks unless sequences were spread over a file."""
    blocks = F.explode(F.sequence(F.floor(F.col("first_sequence") / width), F.floor(F.col("last_sequence") / width)))
    wanted = sequences.select(F.col("sequence").cast("long").alias("sequence")).where("sequence is not null").distinct().withColumn("block", F.floor(F.col("sequence") / width))
    hit = index.withColumn("block", blocks).join(wanted, "block").where("sequence between first_sequence and last_sequence")
    return hit.select(index.columns).dropDuplicates(["path", "offset"])


def ranges(rows: DataFrame, gap: int = GAP, most: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges (path, start, end) that hold rows of an index: neighbours in a file are joined over small gaps, up to about `most` bytes."""
    order = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("span")
    apart = F.coalesce(F.col("offset") - F.lag(end).over(order) > gap, F.lit(True))
    rows = rows.select("path", "offset", "span").withColumn("island", F.sum(apart.cast("int")).over(order))
    first = F.min("offset").over(Window.partitionBy("path", "island"))
    rows = rows.withColumn("piece", F.floor((F.col("offset") - first) / most))
    return rows.groupBy("path", "island", "piece").agg(F.min("offset").alias("start"), F.max(end).alias("end")).select("path", "start", "end")


def read(spark: SparkSession, path: str, found: DataFrame, most: int = records.MAX_PAYLOAD) -> DataFrame:
    """All records of byte ranges (path, start, end) of a log, as read_log gives them; damage in a range has parse_error. Marks of a managed log are not looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = manifest.store_of(path)
        for batch in batches:
            for name, start, end in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                with store.open_input_file(name) as handle:
                    yield from wal.batches(name, start, records.split(handle.read_at(end - start, start), "RESYNC", most))

    size = found.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0  # from the index alone
    return found.repartition(max(1, min(1 << 14, -(-size // RANGE_BYTES))), "path", "start").mapInArrow(run, wal.SCHEMA)


def find(spark: SparkSession, path: str, index: DataFrame, sequences: list[int] | DataFrame) -> DataFrame:
    """The records of sequences (a short list, or a table with a column sequence)."""
    if isinstance(sequences, DataFrame):
        wanted = sequences.select(F.col("sequence").cast("long").alias("sequence")).distinct()
        return read(spark, path, ranges(of_sequences(index, sequences))).where("parse_error is null").join(wanted, "sequence", "left_semi").select(*[c.split()[0] for c in wal.SCHEMA.split(", ")])
    test: Column = F.lit(False)
    for s in sequences:
        test = test | ((F.col("first_sequence") <= s) & (F.col("last_sequence") >= s))
    return read(spark, path, ranges(index.where(test))).where(F.col("parse_error").isNull() & F.col("sequence").isin(list(sequences)))


def between(spark: SparkSession, path: str, index: DataFrame, start_nanos: int | None = None, end_nanos: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The records of a range of times and sequences, inclusive."""
    rec = read(spark, path, ranges(entries(index, first, last, start_nanos, end_nanos))).where("parse_error is null")
    for column, low, high in (("sequence", first, last), ("ts_nanos", start_nanos, end_nanos)):
        rec = rec.where(F.col(column) >= low) if low is not None else rec
        rec = rec.where(F.col(column) <= high) if high is not None else rec
    return rec
