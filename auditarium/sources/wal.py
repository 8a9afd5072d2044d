"""Spark data sources for binary audit logs: `auditwal` (read and write) and `auditjournal` (read).

Reading plans one split for each `splitBytes` of a file (whole files for modes that depend on what came before), and small files share partitions; a
split begins at the first place where a whole record holds (header and data checksums, footer), so splits need no index. Filters on ts_nanos and sequence
are taken over by the reader, which drops records before they become rows. Files are opened through pyarrow's file systems, in the tasks.

Writing: each task writes the segments it holds, in order, from Arrow batches; a segment's records are chained from its first one on, so segments can be written
at once. `continue_log` goes on with an existing log: its numbers follow, and its first record names the log's last one. Files
of tasks that didn't commit are never listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from auditarium.functions.model import FLAG_DELETED, LogConfig

from . import manifest, records
from .manifest import store_of

SCHEMA = "path string, offset long, size int, flags int, ts_nanos long, sequence long, prev_hash string, hash string, event_data binary, parse_error string"
_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("size", pa.int32()), ("flags", pa.int32()), ("ts_nanos", pa.int64()), ("sequence", pa.int64()), ("prev_hash", pa.string()), ("hash", pa.string()), ("event_data", pa.binary()), ("parse_error", pa.string())]
_TESTS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of a folder's files, or of one file, by name."""
    store, base = store_of(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int
    vector: str | None = None  #: a file of offsets of records that are deleted
    border: bool = False  #: whether a record ends where it begins, so that damage there is its own


@dataclass
class Group(InputPartition):
    splits: list[Split]


def grouped(splits: list[Split], most: int) -> list[Group]:
    """Splits in order, several small ones together: at least 32 groups if there is work for them, each of about a 32nd of all bytes or `most`, but no more than 20,000."""
    total = sum(s.end - s.start for s in splits)
    target, out, held = max(1 << 20, min(most, total // 32), total // 20_000), [], 0
    for s in splits:
        if not out or held >= target:
            out.append(Group([]))
            held = 0
        out[-1].splits.append(s)
        held += min(s.end, s.size) - s.start
    return out or [Group([])]


class _WalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "RESYNC").upper()
        self.most, self.step = int(options.get("maxRecordSize", records.MAX_PAYLOAD)), int(options.get("splitBytes", 32 << 20))
        self.tests: list[tuple[str, str, int]] = []
        self.named = None if options.get("files") is None else frozenset(options["files"].split("/"))
        self.headers = options.get("headers") == "true"
        self.generation, self.begin = options.get("generation"), int(options.get("startOffset", 0))
        if self.mode not in records.MODES:
            raise ValueError(f"no mode {self.mode}")

    def _files(self) -> list[tuple[str, int, str | None]]:
        """Path, size and deletion vector of the files to read: a generation's, or all of the folder."""
        if self.generation is None:
            found = [(path, size, None) for path, size in files(self.path, ".wal")]
        else:
            base, sizes = store_of(self.path)[1], dict(files(self.path, ".wal"))  # as they are: a file that was changed since shows
            found = [(f"{base}/{e['name']}", sizes.get(f"{base}/{e['name']}", e["size"]), e.get("vector")) for e in manifest.load(self.path, int(self.generation)).ordered()]
        return [f for f in found if self.named is None or f[0].rpartition("/")[2] in self.named]

    def partitions(self) -> list[Group]:
        step = self.step if self.mode == "RESYNC" and not self.headers else 1 << 62
        return grouped([Split(path, at, min(size, at + step), size, vector) for path, size, vector in self._files() for at in range(self.begin, size, step)], self.step)

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        for split in group.splits:
            found = self._whole(split) if self.headers or self.mode != "RESYNC" else self._split(split)
            yield from found if split.vector is None else self._marked(split, found)

    def _marked(self, split: Split, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches with the deleted flag set where the segment's vector names the record."""
        store, base = store_of(self.path)
        dead = read_vector(store, f"{base}/{manifest.FOLDER}/{split.vector}")
        for batch in batches:
            hit = np.isin(batch.column("offset").to_numpy(), dead) & batch.column("parse_error").is_null().to_numpy(zero_copy_only=False)
            flags = batch.column("flags").to_numpy(zero_copy_only=False)
            flags = pa.array(np.where(hit, np.nan_to_num(flags).astype(np.int32) | FLAG_DELETED, flags), pa.int32(), from_pandas=True)
            yield batch.set_column(batch.schema.get_field_index("flags"), "flags", flags)

    def _whole(self, split: Split) -> Iterator[pa.RecordBatch]:
        """A file from its beginning, block by block: headers by seeking from one to the next, or records until a mode ends it."""
        store, _ = store_of(self.path)
        with store.open_input_file(split.path) as handle:
            found = records.walked(handle.read_at, split.size, self.most) if self.headers else records.ended(handle.read_at, split.size, self.mode, self.most, self.step)
            yield from self._rows(split, 0, found)

    def _split(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        more = self.most + records.OVERHEAD
        with store.open_input_file(split.path) as handle:
            handle.seek(split.start)
            data = handle.read(min(split.size, split.end + more) - split.start)
        begin = 0
        inside = split.start and not split.border
        if inside and not isinstance(records.record_at(data, 0, self.most), records.Record):
            # what leads up to the first record here belongs to the split before
            begin = data.find(records.MARK)
            while begin >= 0 and not isinstance(records.record_at(data, begin, self.most), records.Record):
                begin = data.find(records.MARK, begin + 1)
        rows: list[tuple] = []
        lost = (len(data) if begin < 0 else begin) - more  # the split before read no further
        if inside and lost > 0 and not self.tests:
            rows.append((split.path, split.start + more, lost, None, None, None, None, None, None, "magic"))
        if begin < 0:
            begin = len(data)
        yield from self._rows(split, split.start, records.split(data, self.mode, self.most, begin, split.end - split.start), rows)

    def _rows(self, split: Split, start: int, found, rows: list[tuple] | None = None) -> Iterator[pa.RecordBatch]:
        return batches(split.path, start, found, self.tests, self.headers, rows)


def batches(path: str, start: int, found, tests=(), headers: bool = False, rows: list[tuple] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of what is found from a place of a file on, behind rows; with tests no damage. Of headers, hash is the record's checksum in hexadecimal."""
    rows = rows or []
    for got in found:
        if isinstance(got, records.Damage):
            if not tests:
                rows.append((path, start + got.offset, min(got.size, 2**31 - 1), None, None, None, None, None, None, got.error))
        elif all(getattr(getattr(got, name), test)(value) for name, test, value in tests):
            rows.append((path, start + got.offset, got.size, got.flags, got.ts_nanos, got.sequence, got.prev_hash.hex(), got.hash or None, None if headers else got.event_data, None))
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


class _FilteringReader(_WalReader):
    """For sessions that let Python sources take filters over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("ts_nanos",), ("sequence",)):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def read_vector(store, name: str) -> np.ndarray:
    """Sorted offsets of a deletion vector."""
    with store.open_input_stream(name) as handle:
        return np.frombuffer(handle.read(), np.int64)


@dataclass
class _Files(WriterCommitMessage):
    entries: list  #: of each file what a manifest says of it


class _WalWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("segmentBytes", 64 << 20))
        self.first, self.prev = options.get("firstSegment"), bytes.fromhex(options.get("prevHash", records.ZERO.hex()))
        self.job = options.get("job")  # of a managed log: files get their names at once, and a list of them is left for the commit

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Files:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        done: list[dict] = []
        out, segment, prev, parts, entry = None, None, records.ZERO, [], {}

        def end() -> None:
            if out is not None:
                out.write(b"".join(parts))
                out.close()
                done.append(entry | {"last_hash": prev.hex()})

        for batch in batches:
            for sequence, ts, data, flags, own in zip(*(batch.column(c).to_pylist() for c in ("sequence", "ts_nanos", "event_data", "flags", "segment")), strict=True):
                if out is None or own != segment or entry["size"] >= self.most:
                    end()
                    if out is None or own != segment:
                        prev = self.prev if self.first is not None and own == int(self.first) else records.ZERO
                    segment, parts = own, []
                    name = f"{'' if self.job else '_'}{segment if segment is not None else 0:012d}-{sequence:020d}-{uuid.uuid4().hex[:8]}.wal"
                    out = store.open_output_stream(f"{base}/{name}")
                    entry = {"name": name, "segment": segment, "records": 0, "size": 0, "first_sequence": sequence, "first_nanos": ts, "last_nanos": ts, "deleted": 0, "deleted_bytes": 0, "vector": None}
                raw = records.encode(sequence, ts, data, prev, flags or 0)
                prev = records.hashlib.sha256(raw).digest()
                parts.append(raw)
                dead = (flags or 0) & FLAG_DELETED
                entry["records"] += 1
                entry["size"] += len(raw)
                entry["deleted"] += dead
                entry["deleted_bytes"] += dead * len(raw)
                entry["last_sequence"], entry["first_nanos"], entry["last_nanos"] = sequence, min(entry["first_nanos"], ts), max(entry["last_nanos"], ts)
                if len(parts) >= 4096:
                    out.write(b"".join(parts))
                    parts = []
        end()
        return _Files(done)

    def commit(self, messages) -> None:
        store, base = store_of(self.path)
        entries = [e for m in messages if m for e in m.entries]
        if self.job:
            store.create_dir(f"{base}/{manifest.FOLDER}", recursive=True)
            with store.open_output_stream(f"{base}/{manifest.FOLDER}/_{self.job}.staged") as out:
                out.write(json.dumps(entries).encode())
            return
        for e in entries:
            store.move(f"{base}/{e['name']}", f"{base}/{e['name'][1:]}")

    def abort(self, messages) -> None:
        store, base = store_of(self.path)
        for m in messages:
            for e in m.entries if m else ():
                store.delete_file(f"{base}/{e['name']}")


class AuditWal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "auditwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _WalReader:
        return (_FilteringReader if self.options.get("takesFilters") == "true" else _WalReader)(self.options)

    def writer(self, schema, overwrite: bool) -> _WalWriter:
        return _WalWriter(self.options)


class _JournalReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[Split]:
        return [Split(path, 0, size, size) for path, size in files(self.path, ".journal")] or [Split("", 0, 0, 0)]

    def read(self, split: Split):
        if split.path:
            store, _ = store_of(self.path)
            with store.open_input_file(split.path) as handle:
                for at, status, position, data, error in records.journal(handle.read()):
                    yield split.path, at, status, position, len(data), data, error


class AuditJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "auditjournal"

    def schema(self) -> str:
        return "path string, offset long, status int, position long, length int, data binary, error string"

    def reader(self, schema) -> _JournalReader:
        return _JournalReader(self.options)


def read_from(spark: SparkSession, path: str, offset: int, max_record_size: int = records.MAX_PAYLOAD) -> DataFrame:
    """The records of one segment from a place on, by seeking there: bytes before it are not read. A place within a record begins with the next one."""
    spark.dataSource.register(AuditWal)
    return spark.read.format("auditwal").options(path=path, maxRecordSize=max_record_size, startOffset=offset).load()


def _chosen(path: str, files: list[str] | None, generation: int | None) -> dict:
    """Options that name what is read: a managed log's generation is the newest one now, and stays so for the DataFrame."""
    generation = manifest.newest(path) if generation is None else generation
    return ({} if files is None else {"files": "/".join(files)}) | ({} if generation is None else {"generation": generation})


def read_log(spark: SparkSession, path: str, mode: str = "RESYNC", include_deleted: bool = True, max_record_size: int = records.MAX_PAYLOAD, split_bytes: int = 32 << 20, files: list[str] | None = None, generation: int | None = None) -> DataFrame:
    """Records of all segments of a log, or of the named files; damaged runs have parse_error. Of a managed log (see managed) the segments of a generation."""
    spark.dataSource.register(AuditWal)
    takes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rec = spark.read.format("auditwal").options(path=path, takesFilters=takes, mode=mode, maxRecordSize=max_record_size, splitBytes=split_bytes, **_chosen(path, files, generation)).load()
    return rec if include_deleted else rec.where(F.col("parse_error").isNotNull() | (F.col("flags").bitwiseAND(1) == 0))


def write_log(ev: DataFrame, path: str, segment_bytes: int = 64 << 20, config: LogConfig | None = None, **options) -> None:
    """Events (sequence, ts, event_data, flags, segment) as a log; one shuffle, by segment, since a segment is chained in order. config: settings that were checked;
    its size of segments counts, and its profile's transforms are the caller's (compliance.apply_profile)."""
    spark = ev.sparkSession
    segment_bytes = config.segment_bytes if config else segment_bytes
    spark.dataSource.register(AuditWal)
    rows = ev.select("sequence", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nanos"), F.col("event_data").cast("binary").alias("event_data"), F.col("flags").cast("int").alias("flags"), F.col("segment").cast("long").alias("segment"))
    rows.repartition("segment").sortWithinPartitions("segment", "sequence").write.format("auditwal").options(path=path, segmentBytes=segment_bytes, **options).mode("append").save()


def read_headers(spark: SparkSession, path: str, max_record_size: int = records.MAX_PAYLOAD, files: list[str] | None = None, generation: int | None = None) -> DataFrame:
    """path, offset, size, flags, ts_nanos, sequence, prev_hash, checksum of a log's records: an index scan that goes from header to header and neither checks nor reads what
    long records hold. A file is one task's, in blocks of 256 KB at most."""
    spark.dataSource.register(AuditWal)
    rec = spark.read.format("auditwal").options(path=path, maxRecordSize=max_record_size, headers="true", **_chosen(path, files, generation)).load()
    return rec.where("parse_error is null").select("path", "offset", "size", "flags", "ts_nanos", "sequence", "prev_hash", F.conv("hash", 16, 10).cast("long").alias("checksum"))


def checked_scan(rec: DataFrame, most: int = 10) -> DataFrame:
    """The good records of rec; raises if a file has more than `most` damaged runs before its first good record, which no log of ours has."""
    good = F.col("parse_error").isNull()
    first = rec.groupBy("path").agg(F.min(F.when(good, F.col("offset"))).alias("first"))
    bad = rec.where(~good).join(first, "path").where(F.col("first").isNull() | (F.col("offset") < F.col("first"))).groupBy("path").count().where(F.col("count") > most).select("path").limit(5).collect()
    if bad:
        raise ValueError(f"not logs: {[r['path'] for r in bad]}")
    return rec.where(good)


def last_record(spark: SparkSession, path: str) -> tuple[int, int, str]:
    """Segment, sequence and hash of a log's last record, from its last file alone; (-1, 0, no hash) of an empty log."""
    try:
        found = [p for p, _ in files(path, ".wal")]
    except FileNotFoundError:
        found = []
    for name in reversed(found):
        row = read_log(spark, f"{path.rstrip('/')}/{name.rpartition('/')[2]}").where("parse_error is null").agg(F.max_by(F.struct("sequence", "hash"), "offset").alias("last")).first()["last"]
        if row is not None:
            return int(name.rpartition("/")[2].split("-")[0] or 0), row["sequence"], row["hash"]
    return -1, 0, records.ZERO.hex()


def continue_log(ev: DataFrame, path: str, segment_bytes: int = 64 << 20) -> None:
    """Writes events behind those of a log: sequences (which count from 1) and segments (from 0) follow the log's last ones, and the first record names the last one's hash."""
    segment, sequence, prev = last_record(ev.sparkSession, path)
    moved = ev.withColumn("sequence", F.col("sequence") + sequence).withColumn("segment", F.col("segment") + segment + 1)
    write_log(moved, path, segment_bytes, prevHash=prev, firstSegment=str(segment + 1))


def archive_segments(path: str, names: list[str], folder: str = "archive") -> list[str]:
    """Moves segments (by path or name) to a folder beside them, where no reader lists them; their new paths."""
    store, base = store_of(path)
    store.create_dir(f"{base}/{folder}", recursive=True)
    out = []
    for name in sorted(n.rpartition("/")[2] for n in names):
        out.append(f"{base}/{folder}/{name}")
        store.move(f"{base}/{name}", out[-1])
    return out


def clean_archive(path: str, before, folder: str = "archive") -> list[str]:
    """Deletes archived segments last changed before a time; their paths."""
    store, base = store_of(path)
    if store.get_file_info(f"{base}/{folder}").type == fs.FileType.NotFound:
        return []
    old = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}")) if f.type == fs.FileType.File and f.mtime and f.mtime.timestamp() < before.timestamp()]
    for name in old:
        store.delete_file(name)
    return sorted(old)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AuditJournal)
    return spark.read.format("auditjournal").option("path", path).load()


def incomplete(journal: DataFrame) -> DataFrame:
    """Entries that were never completed and whose data holds."""
    return journal.where("status = 0 and error is null").select("position", "data")


def check_records(rec: DataFrame, first_sequence: int | None = 1, damaged: bool = False) -> DataFrame:
    """Records with linked: whether prev_hash is the hash of the record before; and inner: the same within a file, where its first record has none before it.

    A file's first record may name the last one of the file before it, or none if its sequence goes on from there (segments are written at once); a log's first record must be
    first_sequence (None: any), without a hash before it. So a file that is missing, the first one too, leaves a record that isn't linked. bound: whether the record's hash alone proves what is
    before it. A first record that names none isn't bound: a file that was replaced as a whole shows only against a manifest's seals (managed.check).
    damaged: damaged runs stay, too, with linked null. The window over files has one row for each."""
    from pyspark.sql import Window

    good = rec.where("parse_error is null")
    files = good.groupBy("path").agg(F.min_by("sequence", "offset").alias("start"), F.max_by(F.struct("hash", "sequence"), "offset").alias("last"))
    ends = files.select("path", F.lag("last").over(Window.orderBy("start", "path")).alias("ahead"))
    whole = F.col("parse_error").isNull()
    before = F.last(F.when(whole, F.col("hash")), True).over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)) if damaged else F.lag("hash").over(Window.partitionBy("path").orderBy("offset"))
    none = F.col("prev_hash") == F.lit(records.ZERO.hex())
    opens = F.lit(True) if first_sequence is None else none & (F.col("sequence") == first_sequence)
    begins = F.when(F.col("ahead").isNull(), opens).otherwise((F.col("ahead.hash") == F.col("prev_hash")) | none & (F.col("sequence") == F.col("ahead.sequence") + 1))
    rows = (rec if damaged else good).withColumn("before", before).join(ends, "path", "left")
    rows = rows.withColumn("inner", F.col("before").isNull() | (F.col("before") == F.col("prev_hash"))).withColumn("bound", F.coalesce(F.col("before") == F.col("prev_hash"), F.col("ahead.hash") == F.col("prev_hash"), F.lit(False)))
    return rows.withColumn("linked", F.when(whole, F.when(F.col("before").isNull(), begins).otherwise(F.col("before") == F.col("prev_hash")))).drop("before", "ahead")
