"""Packing by cutting-stock column generation.

Documents become ids (a public tokenizer's, then the end id). A document is cut into whole sequences of `length` ids and one
rest; so its pieces, and their checksums, are known where it is read, and ids never travel. The histogram of rests has
fewer than `length` rows, whatever the input. Neighbouring lengths are classes, at most `classes` of them (each length is its own if there are
no more), and over their tops a linear program chooses how often to use each pattern (a multiset of classes that fits a sequence): the simplex method
starts from patterns of one class and takes those of first-fit decreasing as its first columns, a knapsack dynamic program over the dual prices finds the next column, and it ends when none improves or what the
basis needs is within one sequence, or `gap` of all, of the bound that the prices prove (or, among many ties, when STALLED columns in a row gained next to nothing or ROUNDS columns a class were tried).
The basis' multiplicities are rounded down and its patterns laid with the longest rests of their classes; the ids by which those are shorter than their
class's top, go to longer rests in their places. What is still open at the end is laid first-fit decreasing.

Assignment: rests of a length are ranked, and the plan gives each rank of a length its sequence and offset. Ranks come from counts by (length,
salt) and a row number within each. A length with n rests has about n / max(RANKED, the root of all rests) salts, so a length that a third of all documents
share is no single task's work, and there are at most `length` plus the root of all rests such groups (24 bytes each: 4 MB at 25 billion documents); they and the
plan, a few rows for each length, are what is broadcast. Whole sequences have no place to look for: they are numbered where they are cut, from 2^40 on.

Nulls: a null text counts as empty and is one piece of the end id; a null doc_id stays null. Repeated rows are packed each. Ties among pieces of one
length are ordered by a hash, then doc_id and start. Very long texts are many whole sequences and a rest. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

LENGTH, END = 2048, 1
TOKENIZER = "byte_bpe_50k"
#: Rests in a group that is ranked, at least; share of the sequences that the plan may need more than the proven bound.
RANKED, CLASSES, GAP, STALLED = 2048, 256, 1e-4, 100
#: Columns for each class, at most: a bound on the driver's time.
ROUNDS = 8
#: Numbers of whole sequences begin here.
WHOLE = 1 << 40


@lru_cache(1)
def _encoders(name: str):
    """The same vocabulary in two libraries: the quick one for ordinary text, the other for texts that hold a special token's string."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), whole, special


def ids_of(text: str, name: str = TOKENIZER) -> np.ndarray:
    """The tokenizer's ids without special tokens added."""
    quick, whole, special = _encoders(name)
    if any(s in text for s in special):
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), np.uint32)


_NAMES = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "whole"]
_PIECES = ", ".join(f"{n} long" for n in _NAMES)


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, name: str = TOKENIZER) -> DataFrame:
    """The pieces of docs' texts, as a stored table. row tells document rows apart; whole is the number of a whole sequence, null for a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        whole = row + WHOLE
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(ids_of(text.as_py() or "", name), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), length):
                    full = at + length <= len(ids)
                    out.append((row, key, at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length].tobytes()), len(ids), whole if full else None))
                    whole += full
                row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=_NAMES)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(cut, _PIECES), "pieces")


def knapsack(sizes: np.ndarray, prices: np.ndarray, length: int) -> tuple[float, dict[int, int]]:
    """The best value of a sequence, and its lengths with their numbers. sizes: sorted; prices: theirs."""
    best, choice = np.zeros(length + 1), np.full(length + 1, -1)
    fit = np.searchsorted(sizes, np.arange(length + 1), "right")
    for room in range(1, length + 1):
        best[room] = best[room - 1]
        if n := fit[room]:
            value = best[room - sizes[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], choice[room] = value[k], k
    found: dict[int, int] = {}
    room = length
    while room:
        k = int(choice[room])
        if k < 0:
            room -= 1
        else:
            found[int(sizes[k])] = found.get(int(sizes[k]), 0) + 1
            room -= int(sizes[k])
    return float(best[length]), found


def _filled(order: list[int], left: dict[int, float], length: int) -> dict[int, int]:
    """The pattern of the longest lengths that still fit."""
    pattern: dict[int, int] = {}
    room = length
    for k in order:
        if k <= room:
            n = min(max(1, int(left[k])), room // k)
            pattern[k] = n
            room -= n * k
            if not room:
                break
    return pattern


def first_fit(counts: dict[int, int], length: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with how often each is used: the longest first, each pattern filled with the longest that still fit, as often as counts allow."""
    left = dict(counts)
    order = sorted(left, reverse=True)
    out = []
    while order:
        pattern = _filled(order, left, length)
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= times * n
        order = [k for k in order if left[k]]
        out.append((pattern, times))
    return out


class Program:
    """The linear program of a histogram: its basis (a pattern for each size), the basis' inverse, and how often each pattern is used."""

    def __init__(self, counts: dict[int, int], length: int):
        self.length, self.sizes = length, np.array(sorted(counts))
        self.demand = np.array([counts[k] for k in self.sizes.tolist()], float)
        self.at = {k: j for j, k in enumerate(self.sizes.tolist())}
        self.basis = [{k: length // k} for k in self.at]
        self.inverse = np.diag(1.0 / np.array([length // k for k in self.at], float))
        # ties among equal demands would let the simplex turn in circles: they are broken by next to nothing
        self.value = self.inverse @ (self.demand * (1 + 1e-7 * np.random.default_rng(1).random(len(self.at))))
        self.first = [pattern for pattern, _ in sorted(first_fit(counts, length), key=lambda x: x[1])]
        self.columns = 0

    def needs(self) -> float:
        return float(self.value.sum())

    def step(self) -> tuple[float, bool]:
        """A lower bound on every solution, and whether a column improved the basis."""
        prices = np.maximum(self.inverse.sum(0), 0)
        while self.first:  # patterns to begin with
            pattern = self.first.pop()
            if sum(prices[self.at[k]] * n for k, n in pattern.items()) > 1 + 1e-9:
                self._enter(pattern)
                return 0.0, True
        worth, pattern = knapsack(self.sizes, prices, self.length)
        bound = max(float(self.sizes @ self.demand) / self.length, float(prices @ self.demand) / max(worth, 1.0))
        return bound, worth > 1 + 1e-9 and self._enter(pattern)

    def _enter(self, pattern: dict[int, int]) -> bool:
        column = sum(self.inverse[:, self.at[k]] * n for k, n in pattern.items())
        ratio = np.where(column > 1e-9, self.value / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        self.basis[out] = pattern
        pivot = self.inverse[out] / column[out]
        self.inverse -= np.outer(column, pivot)
        self.inverse[out] = pivot
        self.value = np.maximum(self.value - column * ratio[out], 0)
        self.value[out] = ratio[out]
        self.columns += 1
        return True


def solved(counts: dict[int, int], length: int, gap: float = GAP) -> tuple[Program, float]:
    """The program of counts, as near to its bound as one sequence or the gap, and the bound."""
    program = Program(counts, length)
    bound, better, best, since = 0.0, True, program.needs(), 0
    while better and since < STALLED and program.columns < ROUNDS * len(counts):
        found, better = program.step()
        bound = max(bound, found)
        if program.needs() - bound < max(1.0, gap * bound):
            break
        since = 0 if program.needs() < best - max(0.05, gap * best / 10) else since + 1
        best = min(best, program.needs()) if not since else best
    return program, bound


class _Stock:
    """The rests that are still open, by length."""

    def __init__(self, counts: dict[int, int], unit: int):
        self.left, self.sorted, self.unit = dict(counts), sorted(counts), unit

    def longest(self, most: int, used: dict[int, int]) -> int:
        """The longest open length up to `most` that `used` leaves; 0: none."""
        for j in range(bisect_right(self.sorted, most) - 1, -1, -1):
            k = self.sorted[j]
            if self.left[k] > used.get(k, 0):
                return k
        return 0

    def laid(self, pattern: dict[int, int], length: int) -> dict[int, int]:
        """A pattern of classes as one of lengths; empty if a class has not enough left."""
        out: dict[int, int] = {}
        for top, n in pattern.items():
            for _ in range(n):
                k = self.longest(top * self.unit, out)
                if k <= (top - 1) * self.unit:
                    return {}
                out[k] = out.get(k, 0) + 1
        room = length - sum(k * n for k, n in out.items())
        while room:  # the longest rest in the place of another, or in the room itself
            swaps = [(self.longest(k + room, out) - k, k) for k in (*out, 0)]
            gain, k = max(swaps)
            if gain <= 0:
                break
            if k:
                out[k] -= 1
                if not out[k]:
                    del out[k]
            out[k + gain] = out.get(k + gain, 0) + 1
            room -= gain
        return out

    def take(self, pattern: dict[int, int], times: int) -> None:
        for k, n in pattern.items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]
                self.sorted.remove(k)


def plan(counts: dict[int, int], length: int = LENGTH, gap: float = GAP, classes: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """Patterns with how often each is used, so that every piece of the histogram (shorter than a sequence) has its place."""
    counts = {int(k): n for k, n in counts.items() if n}
    if not counts:
        return []
    unit = 1
    while len({-(-k // unit) for k in counts}) > classes:
        unit *= 2
    tops: dict[int, int] = {}
    for k, n in counts.items():
        top = min(-(-k // unit), length // unit)
        tops[top] = tops.get(top, 0) + n
    program, _ = solved(tops, length // unit, gap)
    stock, used = _Stock(counts, unit), []
    for times, pattern in sorted(zip(map(int, program.value + 1e-6), program.basis, strict=True), key=lambda x: -max(x[1])):
        while times and (lengths := stock.laid(pattern, length)):
            n = min([times, *(stock.left[k] // m for k, m in lengths.items())])
            stock.take(lengths, n)
            used.append((lengths, n))
            times -= n
    return used + first_fit(stock.left, length)


def lines(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """length, first rank, end rank, number in a pattern, first sequence, offset: where the ranks of a length go."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            lo = ranks.get(k, 0)
            ranks[k] = lo + n * times
            out.append((k, lo, ranks[k], n, sequence, offset))
            offset += n * k
        sequence += times
    return out


def assign(found: DataFrame, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = found.sparkSession
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = found.where("whole is null")
    histogram = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}  # fewer than `length` rows
    group = max(RANKED, int(sum(histogram.values()) ** 0.5))
    salts = spark.createDataFrame([(k, -(-n // group)) for k, n in histogram.items()], "length long, salts long")
    places = spark.createDataFrame(lines(plan(histogram, length, gap)), "length long, lo long, hi long, each long, first long, at long")
    rests = rests.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.col("salts")))
    counts = rests.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("row", "start"), "doc_id", "start", "row"))
    ranked = rests.withColumn("local", local).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    dealt = ranked.join(F.broadcast(places), "length").where("rank >= lo and rank < hi")
    rank = F.col("rank") - F.col("lo")
    dealt = dealt.select(*kept, (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"), (F.col("at") + F.pmod(rank, F.col("each")) * F.col("length")).alias("offset"))
    return dealt.unionByName(found.where("whole is not null").select(*kept, F.col("whole").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack(docs: DataFrame, length: int = LENGTH, gap: float = GAP) -> DataFrame:
    """Pieces of docs' texts with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return assign(pieces(docs, length), length, gap)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
