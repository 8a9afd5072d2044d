"""Media columns: text payloads as 8-bit images in archives, written and read by a Spark data source.

Form: a payload is padded with spaces to a positive multiple of 192 bytes and becomes a greyscale PNG, 192
samples wide, one byte a sample, compressed without loss; a text chunk holds the unpadded length. Equal
payloads give equal files. Images are members of ZIP archives, stored as they are, so that a member can be
read by its offset.

`format("imagearchive")` writes one archive a task and a new one after `archiveBytes`; names are unique for
each attempt, and only archives of committed tasks get into the manifest, so retried or lost tasks leave no
rows. Each commit has a manifest of its own: appending adds one, overwriting removes those before. Reading plans partitions from the manifests as byte ranges of about `rangeBytes`, or of a
`PARTITIONS`-th of all bytes if that is more, so their number is bounded; a range may go on into the next archives. The driver sees
archives, never members. A task reads an archive's directory, takes the members that begin in its range and
sends them on as Arrow batches of at most `batchBytes`. A member that can't be read is tried again by its
offset, on a new handle, `tries` times; then its row has `error` instead of `media`, and the others go on. An archive whose directory can't be read
gives one row, with its name and the error, and a member whose entry there is damaged one row with its place.

Nulls: a null text counts as empty (one row of 192 spaces), a null doc_id stays null. Repeated rows, ties and all: one
member and one row for each. A very long text is one image, held by one task. An empty table gives an empty manifest and no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import shared_dir, table

WIDTH = 192
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PARTITIONS = 20_000
#: What damage to an archive's directory, or to a member, makes readers raise.
DAMAGE = (OSError, ValueError, KeyError, IndexError, RuntimeError, NotImplementedError, EOFError, struct.error, zlib.error, zipfile.BadZipFile)
MANIFEST = "_archives.json"  #: End of the names of manifests, one for each commit.


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def encode(text: bytes) -> bytes:
    """The image of a text's payload."""
    payload = padded(text)
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> tuple[bytes, int]:
    """The payload and its unpadded length; raises ValueError on damage."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(image) < at + 12 + size or struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk at {at}")
        found[kind] = found.get(kind, b"") + body
        at += 12 + size
    width, rows = struct.unpack_from(">II", found[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    return lines[:, 1:].tobytes(), int(found[b"tEXt"].split(b"\0")[1])


def features(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and shares of four ranges of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum())
    shares = np.bincount(x >> 6, minlength=4) / len(x)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    square = int(np.square(x, dtype=np.int64).sum()) / len(x)
    return f"mean={mean:.4f};std={max(0.0, square - mean * mean) ** 0.5:.4f};step={steps / len(x):.4f};q=" + ",".join(f"{s:.4f}" for s in shares)


def _open(path: str):
    """File system and path: a URI of any store that pyarrow knows, or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Range(InputPartition):
    parts: list[tuple[str, int, int]]  #: archive, from, to


@dataclass
class Written(WriterCommitMessage):
    archives: list


def _manifests(store, base: str) -> list[str]:
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(MANIFEST))


def _listed(store, path: str) -> list:
    with store.open_input_stream(path) as handle:
        return json.loads(handle.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.overwrite = overwrite
        self.path, self.limit = options["path"], int(options.get("archiveBytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        done, out, archive, name = [], None, None, ""

        def close():
            if archive:
                archive.close()
                done.append([name, out.tell(), len(archive.infolist())])
                out.close()

        for batch in iterator:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if archive is None or out.tell() > self.limit:
                    close()
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{len(archive.infolist()):08d}.{'' if key.as_py() is None else key.as_py()}.png")
                archive.writestr(member, encode(b"" if not text.is_valid else text.as_buffer().to_pybytes()))
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        before = _manifests(store, base) if self.overwrite else []
        with store.open_output_stream(f"{base}/{uuid.uuid4().hex}{MANIFEST}") as out:
            out.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())
        for path in before:
            archives = _listed(store, path)
            store.delete_file(path)  # first: archives that no manifest names are never read
            for name, *_ in archives:
                store.delete_file(f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        for m in messages:
            for name, *_ in m.archives if m else ():
                store.delete_file(f"{base}/{name}")


def read_member(store, path: str, offset: int, size: int) -> bytes:
    """A stored member's bytes by the offset of its local header."""
    with store.open_input_file(path) as handle:
        handle.seek(offset)
        head = handle.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        handle.seek(offset + 30 + name + extra)
        return handle.read(size)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range, self.batch, self.tries = int(options.get("rangeBytes", 16 << 20)), int(options.get("batchBytes", 4 << 20)), int(options.get("tries", 3))

    def partitions(self) -> list[Range]:
        store, base = _open(self.path)
        archives = [a for path in _manifests(store, base) for a in _listed(store, path)]
        target, out, held = max(self.range, sum(size for _, size, _ in archives) // PARTITIONS), [], 0
        for name, size, _ in archives:
            at = 0
            while at < size:
                if not out or held >= target:
                    out.append(Range([]))
                    held = 0
                end = min(size, at + target - held)
                out[-1].parts.append((name, at, end))
                held, at = held + end - at, end
        return out or [Range([])]

    def _member(self, archive, store, path: str, info) -> tuple[bytes | None, str | None]:
        for attempt in range(self.tries):
            try:
                media = archive.read(info) if not attempt else read_member(store, path, info.header_offset, info.file_size)
                if zlib.crc32(media) != info.CRC:
                    raise ValueError("damaged member")
                return media, None
            except DAMAGE as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return None, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, base = _open(self.path)
        rows, held = [], 0
        for name, start, end in partition.parts:
            for row in self._part(store, f"{base}/{name}", name, start, end):
                rows.append(row)
                held += len(row[3] or b"")
                if held >= self.batch:
                    yield _rows(rows)
                    rows, held = [], 0
        if rows:
            yield _rows(rows)

    def _part(self, store, path: str, name: str, start: int, end: int) -> Iterator[tuple]:
        """Rows of an archive's members that begin in a range; one row with an error for a directory that can't be read, from the range it begins in."""
        try:
            handle = store.open_input_file(path)
            archive = zipfile.ZipFile(handle)
        except DAMAGE as e:
            if start == 0:
                yield None, name, None, None, f"directory: {type(e).__name__}: {e}"
            return
        with handle, archive:
            for info in archive.infolist():
                if start <= info.header_offset < end:
                    media, error = self._member(archive, store, path, info)
                    key = None
                    try:
                        text = info.filename.split(".")[1]
                        key = int(text) if text else None
                    except DAMAGE as e:
                        media, error = None, f"name: {type(e).__name__}: {e}"
                    yield key, name, info.header_offset, media, error


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[name for name, _ in kinds])


class ImageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagearchive"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, media binary, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def write_archives(docs: DataFrame, path: str, mode: str = "append", **options) -> None:
    """docs' doc_id and text as archives in the folder path, beside what is there (append) or in its place (overwrite)."""
    docs.sparkSession.dataSource.register(ImageArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.format("imagearchive").options(path=path, **options).mode(mode).save()


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows doc_id, archive, offset, media, error."""
    spark.dataSource.register(ImageArchive)
    return spark.read.format("imagearchive").options(path=path, **options).load()


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, media, error in zip(batch.column("doc_id").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
            if error:
                raise OSError(f"member of document {key}: {error}")
            image = media.as_buffer().to_pybytes()
            payload, n = decode(image)
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def digests(media: DataFrame) -> DataFrame:
    """Lengths, checksums and features of the payloads read back; a member that could not be read raises."""
    return media.select("doc_id", "media", "error").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path)
    return digests(read_archives(spark, path))
