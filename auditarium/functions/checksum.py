"""Checksums that Spark lacks, as Arrow-batched functions, and compositions of those it has.

CRC32-IEEE, SHA-256 and MD5 are built in (F.crc32, F.sha2, F.md5). Tables are computed from the polynomials.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reversed polynomials.
CRC32C, CRC64_ISO = 0x82F63B78, 0xD800000000000000


@lru_cache(4)
def _tables(polynomial: int) -> np.ndarray:
    """Eight tables of 256: what a byte does to the register, and what it does with k zero bytes behind it."""
    first = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        first = np.where(first & 1, first >> np.uint64(1) ^ np.uint64(polynomial), first >> np.uint64(1))
    out = [first]
    for _ in range(7):
        out.append(first[out[-1] & np.uint64(255)] ^ out[-1] >> np.uint64(8))
    return np.stack(out)


def crcs(rows: list[bytes], polynomial: int, bits: int) -> np.ndarray:
    """The checksums of all rows, eight bytes of each at a time: rows are columns of one register array, so the loop runs over the longest row's eighths only."""
    tables, ones = _tables(polynomial), np.uint64((1 << bits) - 1)
    size = np.array([len(r) for r in rows], np.int64)
    out = np.full(len(rows), ones, np.uint64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(rows), np.uint8)
    start = np.cumsum(size) - size
    begin, size, value = start[order], size[order], out[order]
    for at in range(0, int(size.max(initial=0)), 8):
        n = int(np.searchsorted(-size, -(at + 8), "right"))  # rows with eight bytes more
        if n:
            block = data[begin[:n, None] + np.arange(at, at + 8)].astype(np.uint64)
            block ^= value[:n, None] >> np.arange(0, 64, 8, dtype=np.uint64) & np.uint64(255)
            value[:n] = np.bitwise_xor.reduce(tables[np.arange(7, -1, -1), block], 1)
        few = np.arange(n, int(np.searchsorted(-size, -at, "left")))  # rows that end before
        for k in range(7):
            few = few[size[few] > at + k]
            if not len(few):
                break
            value[few] = tables[0][(value[few] ^ data[begin[few] + at + k]) & np.uint64(255)] ^ value[few] >> np.uint64(8)
    out[order] = value
    return out ^ ones


def crc(data: bytes, polynomial: int, bits: int) -> int:
    return int(crcs([data], polynomial, bits)[0])


def adler(data: bytes, window: int) -> np.ndarray:
    """The rolling sums (a + b << 16, modulo 65521) of every window of data."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    if window <= 0 or len(x) < window:
        return np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(x)))
    weighted = np.concatenate(([0], np.cumsum(x * np.arange(len(x)))))
    begin = np.arange(len(x) - window + 1)
    a = total[window:] - total[: len(begin)]
    b = (begin + window) * a - (weighted[window:] - weighted[: len(begin)])
    return (a + 1) % 65521 + ((b + window) % 65521 << 16)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _numbers(of: Callable[[bytes], int]) -> Callable[[Column], Column]:
    """A column function of a function of bytes; nulls stay null. Made when called: it needs a session."""

    def apply(data: Column) -> Column:
        def each(column: pd.Series) -> pd.Series:
            return column.map(lambda b: None if b is None else _signed(of(bytes(b)))).astype("Int64")

        return F.pandas_udf(each, "long")(data)

    return apply


def _crc_column(polynomial: int, bits: int) -> Callable[[Column], Column]:
    def apply(data: Column) -> Column:
        def each(column: pd.Series) -> pd.Series:
            known = column.notna()
            out = pd.Series(pd.NA, index=column.index, dtype="Int64")
            out[known] = crcs([bytes(b) for b in column[known]], polynomial, bits).view(np.int64)
            return out

        return F.pandas_udf(each, "long")(data)

    return apply


crc32c, crc64 = _crc_column(CRC32C, 32), _crc_column(CRC64_ISO, 64)
#: XXH64 with seed 0 (Spark's xxhash64 has seed 42).
xxh64 = _numbers(xxhash.xxh64_intdigest)


def rolling(data: Column, window: int) -> Column:
    """An array of the rolling sums of every window of data."""

    def sums(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else adler(bytes(b), window))

    return F.pandas_udf(sums, "array<long>")(data)


def composite(first: Column, second: Column) -> Column:
    """Two checksums in one number: the first above, the second's low 32 bits below."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(second.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


ALGORITHMS = {"CRC32": lambda c: F.crc32(c), "CRC32C": crc32c, "CRC64": crc64, "XXHash64": xxh64}


def checksum(data: Column, algorithm: str = "CRC32C") -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no checksum {algorithm}")
    return ALGORITHMS[algorithm](data.cast("binary"))


def first_mismatch(data: Column, expected: dict[str, Column]) -> Column:
    """The first algorithm whose checksum of data isn't the expected one; null if all are."""
    return F.coalesce(*(F.when(checksum(data, name) != value, F.lit(name)) for name, value in expected.items()))


def block_sums(data: Column, block: int) -> Column:
    """CRC32 of every block of data, in order; none of empty data."""
    n = F.ceil(F.octet_length(data) / block).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.crc32(F.substring(data.cast("binary"), k * block + 1, F.lit(block))))).otherwise(F.array().cast("array<bigint>"))


def bad_block(data: Column, sums: Column, block: int) -> Column:
    """The first block whose CRC32 isn't the stored one, or -1."""
    pairs = F.zip_with(block_sums(data, block), sums, lambda a, b: ~a.eqNullSafe(b))
    return F.array_position(pairs, True).cast("int") - 1
