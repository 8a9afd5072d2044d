"""Substring dedup by repeated-phrase automata.

A word is removed if a window of `window` neighbouring words that covers it begins earlier elsewhere (at a smaller document id, or earlier in
the same document). Every occurrence is found, and equal means equal words.

1. Phrases. Each window is named by the least hash among the runs of PHRASE words in it, so equal windows have equal names, and one
   phrase names some neighbouring windows (about one phrase in nine words is a name). Names are counted, combined before the shuffle; this passes over
   all documents, and hashes only select: a passage can only recur where a name does.
2. Confirming. Documents are dealt to shards of about SHARD_BYTES. There the runs of text that recurring names stand for are cut out, and equal runs
   are combined to a count and the earliest place before they leave, then once more by (name, run). The different runs of a name meet in one task, which confirms those
   windows that occur again and their earliest place; a name with over HOT different runs is cut into windows first, which are counted one by one. Neighbouring
   windows whose earliest places are neighbours, too, are one passage.
3. Automata. Each shard gets the passages that its documents hold, each once (a join of (name, run) with one row a run on one side), compiles them to an Aho-Corasick
   automaton over word numbers, and streams the whole texts of all its documents through it. So each document meets one automaton, however many
   there are, every occurrence of every passage is located in the text itself, and a passage that all documents share costs each shard one pattern.
   Where a match isn't the passage's earliest place, its words go.

Documents with the same text as an earlier one lose all words that a window covers, and take no part in step 2. Nothing is capped. A shard's automaton
is bounded by the shard's text; its documents are read one after another.

Words are runs of bytes other than white space. Nulls: a null text has no words; a null doc_id counts as smaller than all. Repeated rows are one
document, each row returned; rows with one id and different texts are told apart by text and ordered by its hash (ties have no other order). A very long text
is one document of one shard, held as a whole by its task. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE_WORDS, U64, gram_hashes, mixed, signed, slices, table, word_hashes, words, written

WINDOW, PHRASE = 20, 4
HOT = 2000
#: Text of a shard of documents; words of runs whose windows are confirmed together.
SHARD_BYTES, CONFIRM_WORDS, MOST_TASKS = 8 << 20, 200_000, 100_000
#: Windows that are laid out at once; what a run costs beside its text while it is held.
BLOCK, HELD = 1 << 15, 400
NO_ID = -(1 << 63)
WHITE = " \t\n\v\f\r"
#: Kinds of a shard's rows, in the order in which they come.
COPY, PART, DOCUMENT = 0, 1, 2


def names(h: np.ndarray, at: np.ndarray, window: int, phrase: int):
    """Hash, row, first and last window (in words of the row) of each phrase that names windows. h: word hashes, at: where rows begin."""
    size = np.diff(at)
    n = np.maximum(size - window + 1, 0)
    if not n.sum():
        return (np.zeros(0, np.int64),) * 4
    grams = gram_hashes(h, phrase)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][owner] + first
    view, least = np.lib.stride_tricks.sliding_window_view(grams, window - phrase + 1), np.empty(len(start), np.int64)
    for a in range(0, len(start), BLOCK):  # a block's windows are laid out, not all of a long text
        part = start[a : a + BLOCK]
        least[a : a + BLOCK] = view[part].argmin(1) + part
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(least)) - 1
    return signed(grams[least[head]]), owner[head], first[head], first[tail]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with id (never null), dk (a hash that tells documents apart) and a text that isn't null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("dk"), text.alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """docs with text compressed, for the way through a shuffle."""
    place = docs.columns.index("text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([None if not t.is_valid else pack.compress(t.as_buffer()) for t in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(shrink, T.StructType([T.StructField("text", T.BinaryType()) if k == place else f for k, f in enumerate(docs.schema)]))


def unpacked(data: pa.Scalar, by: zstandard.ZstdDecompressor) -> bytes | None:
    return by.decompress(data.as_buffer()) if data.is_valid else None


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """h, id, dk, lo, hi: each phrase that names windows of a document, and the first and last of them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("dk"))
            for row, data, offsets in slices(batch.column("text")):
                starts, ends, at = words(data, offsets, SPACE_WORDS)
                h, owner, lo, hi = names(word_hashes(data, starts, ends), at, window, phrase)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[row + owner]), pa.array(keys[row + owner]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["h", "id", "dk", "lo", "hi"])

    return docs.select("id", "dk", "text").mapInArrow(found, "h long, id long, dk long, lo int, hi int")


def mark_of(text: bytes) -> int:
    x = xxhash.xxh64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def by_shard(parts: dict[int, DataFrame], shards: int, begin: Callable, schema: str | T.StructType) -> DataFrame:
    """The rows of parts (by kind; each with dk, which tells the shard) as they come to shards: begin(shard) makes what takes them, with take(kind, batch) and
    end(), both of which yield batches of schema. A shard's rows come kind by kind to one task, which may get several shards, one after another."""
    rows = None
    for kind, df in parts.items():
        part = df.withColumn("__shard", F.pmod("dk" if kind != PART or "shard" not in df.columns else "shard", F.lit(shards)) * 4 + kind)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taker = None, None
        for batch in batches:
            key = np.asarray(batch.column("__shard"))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                shard, kind = divmod(int(key[a]), 4)
                if shard != now:
                    if taker is not None:
                        yield from taker.end()
                    now, taker = shard, begin(shard)
                yield from taker.take(kind, batch.slice(a, b - a))
        if taker is not None:
            yield from taker.end()

    # a few shards a task, so that tasks don't grow with the input; so many tasks at most that a driver can plan them
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards // 4, MOST_TASKS))
    return rows.repartition(tasks, F.floor(F.col("__shard") / 4)).sortWithinPartitions("__shard").mapInArrow(run, schema)


_UNIT = pa.schema([("h", pa.int64()), ("mark", pa.int64()), ("unit", pa.binary()), ("n", pa.int64()), ("id", pa.int64()), ("dk", pa.int64()), ("lo", pa.int32()), ("shard", pa.int64())])


class _Units:
    """Cuts runs of text out of a shard's documents, equal ones combined."""

    def __init__(self, shard: int, window: int):
        self.shard, self.window = shard, window
        self.copies: set[tuple[int, int]] = set()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.names: tuple[np.ndarray, ...] | None = None
        self.seen: set[tuple[int, int]] = set()
        self.found: dict[tuple[int, bytes], list] = {}
        self.held = 0
        self.by = zstandard.ZstdDecompressor()

    def take(self, kind: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("dk"))
        if kind == COPY:
            self.copies.update(zip(ids.tolist(), keys.tolist(), strict=True))
            return
        if kind == PART:
            self.parts.append((keys, ids, *(np.asarray(batch.column(c)) for c in ("h", "lo", "hi"))))
            return
        if not self.parts:
            return
        if self.names is None:
            every = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            order = np.lexsort(every[::-1])
            every = [x[order] for x in every]
            new = np.ones(len(order), bool)  # a repeated row names its windows again
            new[1:] = np.any([x[1:] != x[:-1] for x in every], 0)
            self.names, self.parts = tuple(x[new] for x in every), [()]
        dk, own, h, lo, hi = self.names
        begin, end = np.searchsorted(dk, keys, "left").tolist(), np.searchsorted(dk, keys, "right").tolist()
        for k, (doc, key) in enumerate(zip(ids.tolist(), keys.tolist(), strict=True)):
            if begin[k] == end[k] or (doc, key) in self.copies or (doc, key) in self.seen:
                continue
            self.seen.add((doc, key))
            w = unpacked(batch.column("text")[k], self.by).split()  # bytes.split() splits at the same six bytes
            at = slice(begin[k], end[k])
            for who, name, first, last in zip(own[at].tolist(), h[at].tolist(), lo[at].tolist(), hi[at].tolist(), strict=True):
                if who != doc:
                    continue
                unit = b" ".join(w[first : last + self.window])
                here = (doc, key, first)
                got = self.found.get((name, unit))
                if got is None:
                    self.found[name, unit] = [1, here]
                    self.held += len(unit) + HELD
                else:
                    got[0] += 1
                    got[1] = min(got[1], here)
            if self.held > 4 * SHARD_BYTES:
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        rows = [(h, mark_of(unit), unit, n, *least, self.shard) for (h, unit), (n, least) in self.found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _UNIT, strict=True)], schema=_UNIT)
        self.found, self.held = {}, 0


_PASSAGE = pa.schema([("h", pa.int64()), ("mark", pa.int64()), ("passage", pa.binary()), ("id", pa.int64()), ("dk", pa.int64()), ("lo", pa.int32())])
_PASSAGES = "h long, mark long, passage binary, id long, dk long, lo int"


def confirmed_of(units: list[tuple], window: int) -> list[tuple]:
    """Passages (h, mark, text, earliest place) of units (h, mark, text, count, id, dk, lo) of whole names: the runs of their windows that occur more than once."""
    number: dict[bytes, int] = {}
    texts = [u[2].split() for u in units]
    size = np.array([len(t) for t in texts])
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(size.sum()))
    n = size - window + 1
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h, count, ident, dk, lo = (np.array([u[k] for u in units], np.int64)[owner] for k in (0, 3, 4, 5, 6))
    lo = lo + at
    grams = gram_hashes(mixed(flat.astype(U64) + U64(1)), window)[(np.cumsum(size) - size)[owner] + at]
    key = mixed(grams ^ (h.view(U64) * U64(0x9FB21C651E98DF25)))
    order = np.lexsort((lo, dk, ident, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new][group]  # the earliest of equal windows
    again = np.bincount(group, count)[group] > 1
    ident, dk, lo = ident[first], dk[first], lo[first]
    goes_on = np.zeros(len(order), bool)
    goes_on[1:] = again[:-1] & (owner[1:] == owner[:-1]) & (ident[1:] == ident[:-1]) & (dk[1:] == dk[:-1]) & (lo[1:] == lo[:-1] + 1)
    heads = np.flatnonzero(again & ~goes_on)
    ends = np.append(heads[1:], len(order)) if len(heads) else heads
    out = []
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        many = int(again[a:b].sum())  # what isn't again ends the run
        u, k = int(owner[a]), int(at[a])
        out.append((units[u][0], units[u][1], b" ".join(texts[u][k : k + many + window - 1]), int(ident[a]), int(dk[a]), int(lo[a])))
    return out


def confirmed(units: DataFrame, window: int, hot: int) -> DataFrame:
    """h, mark, passage, id, dk, lo: what recurs of each run (h, mark) of units (h, mark, unit, n, id, dk, lo), and its earliest place."""
    least = F.min(F.struct("id", "dk", "lo")).alias("e")
    runs = written(units.groupBy("h", "mark", "unit").agg(F.sum("n").alias("n"), least).select("h", "mark", "unit", "n", "e.id", "e.dk", "e.lo"), "runs")
    many = written(runs.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("h"), "hot")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_words = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "mark", "unit", "n", "id", "dk", "lo")), strict=True):
                if n_words >= CONFIRM_WORDS and held[-1][0] != row[0]:
                    yield from done(held)
                    held, n_words = [], 0
                held.append(row)
                n_words += row[2].count(b" ") + 1
        if held:
            yield from done(held)

    def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows := confirmed_of(held, window):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PASSAGE, strict=True)], schema=_PASSAGE)

    plain = runs.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(grouped, _PASSAGES)
    # a name with many different runs: its windows are counted one by one
    each = windows_of(runs.join(many, "h", "left_semi"), window)
    first = each.groupBy("h", "text").agg(F.sum("n").alias("n"), least).where("n > 1").select("h", F.xxhash64("text").alias("word"), F.md5("text").alias("sum"), "e.id", "e.dk", "e.lo")
    single = each.select("h", "mark", F.col("text").alias("passage"), F.xxhash64("text").alias("word"), F.md5("text").alias("sum")).join(first, ["h", "word", "sum"]).select("h", "mark", "passage", "id", "dk", "lo")
    return plain.unionByName(single)


def windows_of(rows: DataFrame, window: int) -> DataFrame:
    """h, mark, text, n, id, dk, lo of each window of units."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, mark, unit, n, ident, dk, lo in zip(*(batch.column(c).to_pylist() for c in ("h", "mark", "unit", "n", "id", "dk", "lo")), strict=True):
                w = unit.split()
                out += [(h, mark, b" ".join(w[k : k + window]), n, ident, dk, lo + k) for k in range(len(w) - window + 1)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "mark", "text", "n", "id", "dk", "lo"])

    return rows.select("h", "mark", "unit", "n", "id", "dk", "lo").mapInArrow(cut, "h long, mark long, text binary, n long, id long, dk long, lo int")


class Automaton:
    """Passages (text, earliest place) as one Aho-Corasick automaton. Words are numbers, written as digits so that no node has more than BASE branches;
    digits of each place have letters of their own, so a match begins and ends with a word."""

    BASE = 64

    def __init__(self, passages: dict[bytes, tuple[int, int, int]]):
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number)) for w in p.split()] for p in passages]
        self.width = 1
        while self.BASE**self.width < len(number):
            self.width += 1
        letters = []
        for k in range(len(number)):
            digits = ""
            for place in range(self.width):
                k, digit = divmod(k, self.BASE)
                digits += chr(1 + place * self.BASE + digit)
            letters.append(digits)
        self.code = {w: letters[k] for w, k in number.items()}
        self.size, self.place = [len(t) for t in texts], list(passages.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(texts):
            self.automaton.add_word("".join([letters[x] for x in t]), k)
        if texts:
            self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """Begin, end and the passage's earliest place of every occurrence in words."""
        if self.size:
            get, none, width = self.code.get, "\0" * self.width, self.width
            for last, k in self.automaton.iter("".join([get(w, none) for w in words])):
                end = (last + 1) // width
                yield end - self.size[k], end, self.place[k]


class _Streamed:
    """Compiles a shard's passages and streams its documents through them; emit(batch, texts, their words, which of these stay or None) makes batches of results."""

    def __init__(self, window: int, emit: Callable):
        self.window, self.emit = window, emit
        self.copies: set[tuple[int, int]] = set()
        self.passages: dict[bytes, tuple[int, int, int]] = {}
        self.automaton: Automaton | None = None
        self.by = zstandard.ZstdDecompressor()

    def take(self, kind: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = batch.column("id").to_pylist(), batch.column("dk").to_pylist()
        if kind == COPY:
            self.copies.update(zip(ids, keys, strict=True))
            return
        if kind == PART:
            self.passages.update(zip(batch.column("passage").to_pylist(), zip(ids, keys, batch.column("lo").to_pylist(), strict=True), strict=True))
            return
        if self.automaton is None:
            self.automaton, self.passages = Automaton(self.passages), {}
        texts = [unpacked(text, self.by) for text in batch.column("text")]
        words = [t.split() for t in texts]
        yield self.emit(batch, texts, words, [self._kept(*x) for x in zip(ids, keys, words, strict=True)])

    def _kept(self, doc: int, dk: int, w: list[bytes]) -> np.ndarray | None:
        """Which words stay; None: all."""
        if (doc, dk) in self.copies:
            return np.full(len(w), len(w) < self.window)
        edge = None
        for begin, end, place in self.automaton.found(w):
            if place != (doc, dk, begin):
                if edge is None:
                    edge = np.zeros(len(w) + 1, np.int64)
                edge[begin] += 1
                edge[end] -= 1
        return None if edge is None else np.cumsum(edge[:-1]) == 0

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def streamed(docs: DataFrame, emit: Callable, schema: str | T.StructType, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """emit's batches for all rows of docs (id, dk, text and others), with what stays of their words."""
    keyed = docs.select("id", "dk", "text")
    sums = written(keyed.select("id", "dk", F.md5(F.col("text").cast("binary")).alias("sum"), F.octet_length("text").cast("long").alias("size")), "documents")
    shards = max(1, math.ceil((sums.agg(F.sum("size")).first()[0] or 0) / shard_bytes))
    first = sums.groupBy("sum").agg(F.min(F.struct("id", "dk")).alias("f"), F.count("*").alias("n")).where("n > 1").select("sum", "f")
    copies = written(sums.join(first, "sum").where("f.dk <> dk or f.id <> id").select("id", "dk").distinct(), "copies")
    named = phrases(keyed, window, phrase)
    # a table of its own, so that the join below has a plain shuffle on either side, which can be split where a phrase is hot
    again = written(named.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "phrases")
    parts = {COPY: copies, PART: named.join(again.hint("shuffle_hash"), "h"), DOCUMENT: packed(keyed)}
    units = written(by_shard(parts, shards, lambda shard: _Units(shard, window), "h long, mark long, unit binary, n long, id long, dk long, lo int, shard long"), "units")
    passages = units.select("h", "mark", "shard").join(confirmed(units, window, hot), ["h", "mark"]).select("shard", "passage", "id", "dk", "lo")
    return by_shard({COPY: copies, PART: passages, DOCUMENT: packed(docs)}, shards, lambda shard: _Streamed(window, emit), schema)


def kept_text(data: bytes, keep: np.ndarray | None) -> str:
    """A text without the words that don't stay and the white space behind them; what stays is as it was."""
    if keep is None:
        return data.decode()
    raw = np.frombuffer(data, np.uint8)
    starts, _, _ = words(raw, np.array([0, len(raw)]), SPACE_WORDS)
    if not len(starts):
        return data.decode()
    size = np.diff(np.append(starts, len(raw)))
    return raw[np.concatenate((np.ones(starts[0], bool), np.repeat(keep, size)))].tobytes().decode()


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each document: words, words removed, and the digest of what is kept."""

    def digests(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]], masks: list) -> pa.RecordBatch:
        total, removed, digest = [], [], []
        for w, mask in zip(words, masks, strict=True):
            kept = w if mask is None else [x for x, k in zip(w, mask.tolist(), strict=True) if k]
            total.append(len(w))
            removed.append(len(w) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        ids = [None if x == NO_ID else x for x in batch.column("id").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return streamed(_keyed(docs), digests, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, phrase, hot, shard_bytes)


def rewritten(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with repeated words taken out of text and n_chars (if there) counted anew; documents of which no word is left go. Other columns stay."""
    names = docs.columns
    place = names.index("text")
    ident, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("others"), F.col("text").isNull().alias("none"), ident.alias("id"), F.xxhash64(ident, text).alias("dk"), text.alias("text"))

    def cut(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]], masks: list) -> pa.RecordBatch:
        none = batch.column("none").to_pylist()
        left = [None if null else kept_text(t, m) for t, m, null in zip(texts, masks, none, strict=True)]
        keep = [m is None or not len(m) or bool(t.strip(WHITE)) for t, m in zip(left, masks, strict=True)]
        columns = batch.column("others").flatten()
        if "n_chars" in names:
            k = [c for c in names if c != "text"].index("n_chars")
            columns[k] = pa.array([n if m is None or t is None else len(t) for t, m, n in zip(left, masks, columns[k].to_pylist(), strict=True)], columns[k].type)
        columns.insert(place, pa.array(left, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return streamed(rows, cut, docs.schema, window, phrase, hot, shard_bytes)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
  every AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM d),
  kept AS (SELECT e.doc_id, count(c.k) AS n_removed, string_agg(x, ' ' ORDER BY e.k) FILTER (c.k IS NULL) AS left_over FROM every e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.k = c.k GROUP BY e.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
