"""Comparing a log's files with those of a shadow by blocks, wherever they have moved to.

The shadow's file is cut into blocks, each with a weak sum and a strong hash. Over the other file the weak sum is rolled: its value at every place comes from two cumulative sums, so a piece is a few
numpy operations, and only places whose weak sum is a block's are hashed. What no block covers is what differs. Bytes that were put in or taken out shift what follows
without making it differ. Files are pairs of tasks' inputs, read in pieces; nothing is shuffled but the list of files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditarium.sources.manifest import store_of
from auditarium.sources.wal import files

BLOCK, PIECE = 4096, 4 << 20
OUT = "name string, kind string, start long, end long, shadow_start long"


def weak_sums(data: np.ndarray, block: int) -> np.ndarray:
    """The rolling sum of every run of block bytes: the sum of its bytes, and of these weighted by their distance from its end, each modulo 2^16."""
    if len(data) < block:
        return np.zeros(0, np.int64)
    x = data.astype(np.int64)
    plain = np.concatenate(([0], np.cumsum(x)))
    weighted = np.concatenate(([0], np.cumsum(x * np.arange(len(x)))))
    n = len(x) - block + 1
    first = plain[block:] - plain[:n]
    second = (np.arange(n) + block) * first - (weighted[block:] - weighted[:n])
    return (first & 0xFFFF) | ((second & 0xFFFF) << 16)


def matched(read_at, size: int, shadow_at, shadow_size: int, block: int = BLOCK, piece: int = PIECE) -> Iterator[tuple[str, int, int, int | None]]:
    """kind, start, end, shadow_start of runs of a file: same (the shadow has it there), moved (it has it elsewhere) or changed. Blocks are taken from the left, those where they are
    expected first."""
    blocks: dict[int, list[tuple[bytes, int]]] = {}
    for at in range(0, shadow_size, piece - piece % block):
        data = np.frombuffer(shadow_at(min(piece - piece % block, shadow_size - at), at), np.uint8)
        whole = len(data) // block * block
        x = data[:whole].reshape(-1, block).astype(np.int64)
        sums = (x.sum(1) & 0xFFFF) | (((x * np.arange(block, 0, -1)).sum(1) & 0xFFFF) << 16)
        for k, s in enumerate(sums.tolist()):
            blocks.setdefault(s, []).append((hashlib.sha256(data[k * block : (k + 1) * block]).digest(), at + k * block))
    tail = shadow_size % block
    end_block = hashlib.sha256(shadow_at(tail, shadow_size - tail)).digest() if tail else None
    known = np.array(sorted(blocks), np.int64)
    at, expected, out = 0, 0, []

    def add(kind: str, start: int, end: int, there: int | None) -> None:
        if out and out[-1][0] == kind and out[-1][2] == start and (there is None or out[-1][3] + out[-1][2] - out[-1][1] == there):
            out[-1][2] = end
        elif end > start:
            out.append([kind, start, end, there])

    while at < size:
        data = np.frombuffer(read_at(min(piece + block, size - at), at), np.uint8)
        sums = weak_sums(data, block)
        hits = np.flatnonzero(np.isin(sums, known)) if len(sums) else np.zeros(0, np.int64)
        done, stop = 0, min(len(data), piece) if at + len(data) < size else len(data)
        k = 0
        while True:
            k = int(np.searchsorted(hits, done))
            if k >= len(hits) or hits[k] >= stop:
                break
            place, found = int(hits[k]), None
            strong = hashlib.sha256(data[place : place + block]).digest()
            for digest, there in blocks[int(sums[place])]:
                if digest == strong and (found is None or there in (expected, at + place)):
                    found = there
            if found is None:
                hits = np.delete(hits, k)
                continue
            add("changed", at + done, at + place, None)
            add("same" if found == at + place else "moved", at + place, at + place + block, found)
            done, expected = place + block, found + block
        if at + len(data) >= size:  # the end: a shadow's last block is shorter
            rest = bytes(data[done:])
            if tail and len(rest) >= tail and hashlib.sha256(rest[len(rest) - tail :]).digest() == end_block:
                add("changed", at + done, size - tail, None)
                add("same" if size == shadow_size else "moved", size - tail, size, shadow_size - tail)
            else:
                add("changed", at + done, size, None)
            break
        if done < stop:
            add("changed", at + done, at + stop, None)
            done = stop
        at += done
    yield from map(tuple, out)


def differences(spark: SparkSession, path: str, shadow: str, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """name, kind, start, end, shadow_start: runs of all files of a log against those of the same name in the shadow. Files on one side alone are missing (the log has none) or extra, as a whole."""
    own, other = ({p.rpartition("/")[2]: (p, n) for p, n in files(x, ".wal")} for x in (path, shadow))
    rows = [(name, *(own.get(name) or (None, None)), *(other.get(name) or (None, None))) for name in sorted({*own, *other})]  # one row a file

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = store_of(path)[0], store_of(shadow)[0]
        for batch in batches:
            for name, mine, size, theirs, shadow_size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mine is None or theirs is None:
                    runs = [("missing" if mine is None else "extra", 0, shadow_size if mine is None else size, None)]
                else:
                    with a.open_input_file(mine) as x, b.open_input_file(theirs) as y:
                        runs = list(matched(x.read_at, size, y.read_at, shadow_size, block))
                if runs:
                    columns = [pa.array([name] * len(runs)), *(pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "kind", "start", "end", "shadow_start"])

    listed = spark.createDataFrame(rows, "name string, mine string, size long, theirs string, shadow_size long")
    return listed.repartition(parts or max(1, min(len(rows), 1 << 14)), "name").mapInArrow(compare, OUT)
