"""Logs as streams: `auditwalstream` follows a log's files as they grow, and a managed log's generations.

Offsets of a plain log are bytes a file, always ends of whole records: `at` has those of the newest files, which may still grow; all files up to `done` by name are closed and
read to their ends. So an offset stays small whatever the log, and a restarted query goes on from its checkpoint. A record that is only half written waits; what is
damaged is reported once a whole record stands behind it, or its file is closed. Offsets of a managed log are generations: what was appended since comes, compactions bring nothing.

Each file's new bytes are split like those of a batch read, so a long backlog is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from auditarium.sources import manifest, records, wal

OPEN_FILES = 64


def whole_until(read_at, size: int, known: int, most: int = records.MAX_PAYLOAD) -> int:
    """The end of the last whole record up to size, not before known: looked for from the end, in pieces that grow."""
    reach = 64 << 10
    while size > known:
        begin = max(known, size - reach)
        data = read_at(size - begin, begin)
        best, at = -1, 0 if begin == known else data.find(records.MARK)
        while 0 <= at < len(data):
            got = records.record_at(data, at, most)
            if isinstance(got, records.Record):
                best, at = at + got.size, at + got.size
                if records.MARK != data[at : at + 4]:
                    at = data.find(records.MARK, at)
            else:
                at = data.find(records.MARK, at + 1)
        if best >= 0:
            return begin + best
        if begin == known:
            return known
        reach *= 8
    return known


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.open = options["path"], int(options.get("openFiles", OPEN_FILES))
        self.reader = wal._WalReader(options)
        self.managed = manifest.newest(self.path) is not None

    def initialOffset(self) -> dict:
        return {"generation": 0} if self.managed else {"done": "", "at": {}}

    def latestOffset(self) -> dict:
        if self.managed:
            return {"generation": manifest.newest(self.path)}
        store, _ = manifest.store_of(self.path)
        try:
            found = wal.files(self.path, ".wal")
        except FileNotFoundError:
            return self.initialOffset()
        closed, growing = found[: -self.open], found[-self.open :]
        at = {}
        for path, size in growing:
            with store.open_input_file(path) as handle:
                at[_name(path)] = whole_until(handle.read_at, size, self.known.get(_name(path), 0), self.reader.most)
        self.known = at
        return {"done": _name(closed[-1][0]) if closed else "", "at": at}

    known: dict[str, int] = {}

    def partitions(self, start: dict, end: dict) -> list:
        if self.managed:
            base = manifest.store_of(self.path)[1]
            ranges = [(f"{base}/{e['name']}", 0, e["size"]) for e in manifest.appended(self.path, start["generation"], end["generation"])]
        else:
            ranges = []
            for path, size in wal.files(self.path, ".wal"):
                name = _name(path)
                first = start["at"].get(name, size if name <= start["done"] else 0)
                last = end["at"].get(name, size if name <= end["done"] else 0)
                ranges.append((path, first, last))
        step = self.reader.step
        return wal.grouped([wal.Split(path, at, min(last, at + step), last, None, at == first) for path, first, last in ranges for at in range(first, last, step)], step)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


def _name(path: str) -> str:
    return path.rpartition("/")[2]


class AuditWalStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "auditwalstream"

    def schema(self) -> str:
        return wal.SCHEMA

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of a log as a stream, damaged runs with parse_error; in the columns of wal.read_log."""
    spark.dataSource.register(AuditWalStream)
    return spark.readStream.format("auditwalstream").options(path=path, **options).load()
