"""What the operators share: tables, a shared folder, and word kernels over Arrow buffers.

The kernels turn a slice of an Arrow string column into flat numpy arrays (bytes, word starts,
word hashes), so that no Python code runs for each word.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text is worked on in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of bytes other than white space, and words of letters, digits and non-ASCII bytes.
SPACE_WORDS = ~_SPACES
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see, below spark.checkpoint.dir. Where that is unset, only a local session may use a folder of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_of(id_col: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows with about max_bytes; null counts as empty, no row is cut."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Start and end of each word, and where each row's words begin (one more entry than rows)."""
    inside = kind[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits (the published splitmix64 constants)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.full(64, _BASE, U64))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _BASE, U64))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    value = data[place + np.repeat(starts, length)].astype(U64)
    value += U64(1)
    value *= powers(int(length.max()))[place]
    return mixed(np.add.reduceat(value, first) ^ (length.astype(U64) << U64(48)))


def hash_of(word: bytes) -> int:
    """word_hashes of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbours in h; runs across rows are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
