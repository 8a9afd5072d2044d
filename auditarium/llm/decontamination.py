"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores postings of the training text: one row for each segment of documents (about SEGMENT_BYTES
of text) with its terms, and for each term its sorted word positions. Segments are built where the
documents are read, so nothing is shuffled and neither a long document nor a common word gathers anywhere. All terms
are stored, so an index (`build_index` makes a table) serves any benchmark, by `find(..., index=...)`.

`search` looks windows up in each segment. A window's terms are ordered by their counts over the whole index,
rarest first: the rarest term's list, moved by its offset, gives candidate starts; each further term's list, moved
by its own offset, is intersected with them. What is left are exact phrases. With slop > 0 matches are instead
the shortest runs of at most the window's length plus slop words of one document that hold all terms, in any order and each
as often as the window does: those that neither end can leave out. They are found by two pointers over the terms' merged lists.

Windows are a query set that is gone through in blocks of at most BLOCK_BYTES of benchmark text, and that bound is what
is sent to tasks, whatever the size of the benchmark; blocks read the same stored index, and each is collected once.

Words are runs of letters, digits and non-ASCII bytes, after A-Z became a-z. A window is `window` neighbouring words of an item;
an item of fewer words, but not none, is one window. Null texts have no words; null ids stay null (as an item id: the text
"null"). Repeated document rows are each returned; items with equal texts (ties) each count; repeated item ids count once. A very long document
is a segment of its own. Empty tables give no hits or no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM_WORDS, U64, lowered, slices, table, word_hashes, words, written

WINDOW = 10
SEGMENT_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
#: Candidates that are looked at together.
STEP = 1 << 20

_INDEX = "segment long, doc_ids array<long>, doc_starts binary, terms binary, counts binary, positions binary"
_INDEX_ARROW = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("doc_starts", "terms", "counts", "positions"))])


def hashed_words(column: pa.Array, max_bytes: int):
    """(first row, word hashes, where each row's words begin) of runs of rows."""
    for row, data, offsets in slices(column, max_bytes):
        data = lowered(data)
        starts, ends, at = words(data, offsets, ALNUM_WORDS)
        yield row, word_hashes(data, starts, ends), at


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs' doc_id and text."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 40  # the number of the segment's first row
        for batch in batches:
            for row, h, at in hashed_words(batch.column("text"), SEGMENT_BYTES):
                order = np.argsort(h, kind="stable")
                h = h[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                first = np.flatnonzero(new)
                ids = batch.column("doc_id").slice(row, len(at) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), h[first], np.diff(np.append(first, len(h))).astype(np.int32), order.astype(np.int32)))], schema=_INDEX_ARROW)
                count += len(ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(segments, _INDEX), "postings")


def term_counts(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each of the wanted terms (sorted hashes) occurs in the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for terms, n in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, n = np.frombuffer(terms.as_buffer(), U64), np.frombuffer(n.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
                hit = terms[at] == own if len(terms) else np.zeros(len(own), bool)
                total[hit] += n[at[hit]]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own[used].view(np.int64)), pa.array(total[used])], names=["term", "n"])

    return {r[0]: r[1] for r in index.select("terms", "counts").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}


class Windows:
    """The windows of some items, ready to be sent: terms, and for each window its terms with their offsets, by rarity once counts are known."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[bytes, set[str]] = {}
        for _, h, at in hashed_words(pa.array([t for _, t in items], pa.string()), 1 << 62):
            for k, (name, _) in enumerate(items):
                own = h[at[k] : at[k + 1]]
                for j in range(max(1, len(own) - window + 1) if len(own) else 0):
                    found.setdefault(own[j : j + window].tobytes(), set()).add(name)
        keys = sorted(found)
        self.items = [sorted(found[k]) for k in keys]
        self.length = np.array([len(k) // 8 for k in keys], np.int64)
        self.terms, ids = np.unique(np.frombuffer(b"".join(keys), U64), return_inverse=True) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))
        width = int(self.length.max(initial=1))
        self.order = np.full((len(keys), width), -1, np.int64)
        self.order[np.arange(width) < self.length[:, None]] = ids
        self.offset = np.zeros_like(self.order) + np.arange(width)

    def by_rarity(self, total: dict[int, int]) -> Windows:
        rarity = np.array([total.get(t, 0) for t in self.terms.view(np.int64).tolist()], np.int64)
        key = np.where(self.order >= 0, rarity[self.order] if len(rarity) else 0, np.iinfo(np.int64).max)
        by = np.argsort(key, 1, kind="stable")
        self.order, self.offset = np.take_along_axis(self.order, by, 1), np.take_along_axis(self.offset, by, 1)
        return self


def _lists(windows: Windows, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
    """Sorted keys (term of the windows, position) of a segment, and where each term's list begins and how long it is."""
    at = np.searchsorted(windows.terms, terms)
    at = np.minimum(at, max(0, len(windows.terms) - 1))
    used = windows.terms[at] == terms if len(windows.terms) else np.zeros(len(terms), bool)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    if not used.all():
        positions = positions[np.repeat(used, counts)]
        at, counts = at[used], counts[used]
        begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    first, size = np.zeros(len(windows.terms), np.int64), np.zeros(len(windows.terms), np.int64)
    first[at], size[at] = begins, counts
    return (np.repeat(at, counts) << 32) | positions, positions, first, size


def _alive(windows: Windows, size: np.ndarray) -> np.ndarray:
    """Windows of which a segment has all terms."""
    probe = windows.order[:, 0]
    alive = np.flatnonzero(size[probe] > 0) if len(probe) else probe
    for k in range(1, windows.order.shape[1]):
        t = windows.order[alive, k]
        alive = alive[(t < 0) | (size[np.maximum(t, 0)] > 0)]
    return alive


def _hits(windows: Windows, keys: np.ndarray, positions: np.ndarray, first: np.ndarray, size: np.ndarray):
    """(window, start, end) of all matches in a segment."""
    probe = windows.order[:, 0]
    alive = _alive(windows, size)
    n = size[probe[alive]]
    cuts = np.searchsorted(np.cumsum(n), np.arange(STEP, int(n.sum()) + STEP, STEP))
    for part in np.split(np.arange(len(alive)), np.minimum(cuts + 1, len(alive))):
        if not len(part):
            continue
        w, m = alive[part], n[part]
        place = positions[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[probe[w]], m)].astype(np.int64)
        w = np.repeat(w, m)
        start = place - windows.offset[w, 0]
        keep = start >= 0
        for k in range(1, windows.order.shape[1]):
            w, start = w[keep], start[keep]
            t = windows.order[w, k]
            want = (t << 32) | (start + windows.offset[w, k])
            keep = (t < 0) | (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want)
        w, start = w[keep], start[keep]
        yield w, start, start + windows.length[w]


def _near(windows: Windows, positions: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray, slop: int):
    """(window, start, end) of all proximity matches in a segment whose documents begin at at."""
    for w in _alive(windows, size).tolist():
        terms, needs = np.unique(windows.order[w, : windows.length[w]], return_counts=True)
        span = int(windows.length[w]) + slop
        lists = [positions[first[t] : first[t] + size[t]].astype(np.int64) for t in terms]
        rare = lists[int(np.argmin([len(x) for x in lists]))]
        rare_docs = np.searchsorted(at, rare, "right") - 1
        lo, hi = np.maximum(at[rare_docs], rare - span + 1), np.minimum(at[rare_docs + 1], rare + span)
        merged = []
        for k, x in enumerate(lists):  # only places that stand near the rarest term, in its document
            i = np.searchsorted(rare, x)
            after, before = np.minimum(i, len(rare) - 1), np.maximum(i - 1, 0)
            x = x[(x >= lo[after]) & (x < hi[after]) | (x >= lo[before]) & (x < hi[before])]
            merged.append(np.stack([x, np.full(len(x), k)]))
        place, kind = np.concatenate(merged, 1)
        order = np.argsort(place)
        place, kind = place[order].tolist(), kind[order].tolist()
        docs = (np.searchsorted(at, place, "right") - 1).tolist()
        have, lacking, left, starts, ends = [0] * len(terms), len(terms), 0, [], []
        for right, k in enumerate(kind):
            have[k] += 1
            lacking -= have[k] == needs[k]
            while left <= right and (docs[left] != docs[right] or place[right] - place[left] >= span or have[kind[left]] > needs[kind[left]]):
                have[kind[left]] -= 1
                lacking += have[kind[left]] == needs[kind[left]] - 1
                left += 1
            # the left end is needed; so is the right one, if this run isn't the last one made longer
            if not lacking and not (starts and starts[-1] == place[left]):
                starts.append(place[left])
                ends.append(place[right] + 1)
        if starts:
            yield np.full(len(starts), w), np.array(starts), np.array(ends)


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """For each document row of the index: row, doc_id, n_words, begins and ends (of matches, in words), items."""
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for seg in batch.to_pylist():
                at = np.frombuffer(seg["doc_starts"], np.int32).astype(np.int64)
                lists = _lists(own, np.frombuffer(seg["terms"], U64), np.frombuffer(seg["counts"], np.int32).astype(np.int64), np.frombuffer(seg["positions"], np.int32))
                got: dict[int, tuple[list, list, set]] = {}
                for w, start, end in (_near(own, *lists[1:], at, slop) if slop else _hits(own, *lists)) if len(lists[0]) else ():
                    doc = np.searchsorted(at, start, "right") - 1
                    for d, k, s, e in zip(*(x[end <= at[doc + 1]].tolist() for x in (doc, w, start, end)), strict=True):
                        begins, ends, items = got.setdefault(d, ([], [], set()))
                        begins.append(s - int(at[d]))
                        ends.append(e - int(at[d]))
                        items.update(own.items[k])
                none: tuple = ([], [], ())
                rows = range(len(at) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([seg["segment"] + d for d in rows], pa.int64()), pa.array(seg["doc_ids"], pa.int64()), pa.array(np.diff(at)), *(pa.array([list(got.get(d, none)[k]) for d in rows], pa.list_(pa.int64())) for k in (0, 1)), pa.array([sorted(got.get(d, none)[2]) for d in rows], pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "begins", "ends", "items"])

    return index.mapInArrow(matches, "row long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>")


def find(docs: DataFrame | None, items: DataFrame, window: int = WINDOW, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Matches of the items' windows in docs (or in an index of them), one row a document row, as search gives them."""
    items = written(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    index = build_index(docs) if index is None else index
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / BLOCK_BYTES))
    found = None
    for k in range(n):
        windows = Windows(sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), window)
        part = search(index, windows.by_rarity(term_counts(index, windows.terms)), slop)
        found = part if found is None else found.unionByName(part)
    if n > 1:
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return found


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, digest = [], []
        for begins, ends, items in zip(*(batch.column(c).to_pylist() for c in ("begins", "ends", "items")), strict=True):
            n, reached = 0, 0
            for b, e in sorted(zip(begins, ends, strict=True)):
                n += max(0, e - max(b, reached))
                reached = max(reached, e)
            hit.append(n)
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(map(len, batch.column("items").to_pylist()), pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: words, words inside windows, items with occurring windows (their number and digest), contaminated."""
    return find(docs, items, window).select("doc_id", "n_words", "begins", "ends", "items").mapInArrow(_covered, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
  items AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS ws FROM benchmark),
  wanted AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS t FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
  windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(ws) >= n)),
  hits AS (SELECT doc_id, i, n, item FROM windows JOIN wanted USING (n, t)),
  words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
  names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
