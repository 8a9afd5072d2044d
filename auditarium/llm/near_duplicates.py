"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams (five words, as 64-bit hashes; a text of fewer words is one n-gram). Two documents are linked if
the Jaccard similarity of their sets reaches the threshold. Result: a row for each document with its class (the least id that links lead
to) and its number of links.

1. Each document's set becomes MinHash values, in bands of rows; `shape_for` takes the most selective shape that finds a pair at the
   threshold with the target recall (pairs above it more surely). Documents with equal sets are one representative with a weight from here on, so copies are never paired.
2. Representatives are shuffled on band hashes. Buckets larger than BLOCK are met block by block, so no task holds a bucket of any size. Pairs
   of which fewer values agree than a pair at the threshold has, but for a chance that is part of the target recall, are passed over; of the others, a spanning forest goes on, never all pairs.
3. Connected candidates are verified together on full n-gram sets, again by blocks: every pair's intersection is counted exactly, the number
   of links is summed for each representative, and a spanning forest of verified links gives the classes.

No bucket, candidate or partner is capped. Counting links of a group without equal sets needs a comparison for each pair in the group, in
blocks that many tasks share; only the forest and the sums leave a task.

Nulls: a null text has no words; a document without words has no links and is its own class; a row with a null doc_id gets a null class and no links.
Repeated rows of one id and text give one row; one id with several texts gives a row for each; of equal ids (ties) it doesn't matter which names a class. A very long
text is one set, held by one task. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import ALNUM_WORDS, U64, gram_hashes, lowered, mixed, signed, slices, table, word_hashes, words, written

GRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 64
BLOCK, VERIFY_BLOCK = 1024, 512


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, out of so many hashes, still find a pair at the threshold with that recall."""
    for rows in range(hashes, 0, -1):
        if 1 - (1 - threshold**rows) ** (hashes // rows) >= recall:
            return hashes // rows, rows
    return hashes, 1


def shape_for(threshold: float, recall: float, hashes: int) -> tuple[int, int, int]:
    """Bands, rows, and how many values must agree, so that a pair at the threshold goes on with the target recall: half of what may be lost is the
    bands', half the binomial chance of fewer agreeing values."""
    lost = (1 - recall) / 2
    bands, rows = bands_for(threshold, 1 - lost, hashes)
    chance = [math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k) for k in range(hashes)]
    least = max(k for k in range(hashes) if sum(chance[:k]) <= lost)
    return bands, rows, least


def gram_sets(column: pa.Array, n: int, max_bytes: int = 1 << 20):
    """(first row, n-gram hashes, sorted and distinct in each row, where each row's begin) of runs of rows."""
    for row, data, offsets in slices(column, max_bytes):
        data = lowered(data)
        starts, ends, at = words(data, offsets, ALNUM_WORDS)
        h = word_hashes(data, starts, ends)
        size = np.diff(at)
        count = np.where(size >= n, size - n + 1, 0)
        place = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        grams, owner = gram_hashes(h, n)[place] if len(place) else np.zeros(0, U64), np.repeat(np.arange(len(size)), count)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            grams = np.concatenate([grams, *(gram_hashes(h[at[k] : at[k + 1]], int(size[k])) for k in short)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
        yield row, grams, np.searchsorted(owner, np.arange(len(size) + 1))


def signatures(docs: DataFrame, n: int = GRAM, hashes: int = HASHES) -> DataFrame:
    """doc_id, two hashes of its n-gram set (k1, k2), the set's size, and its MinHash values (32 bits each), as a stored table."""
    rng = np.random.default_rng(20_240_101)
    factor, shift = (rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2))

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams, at in gram_sets(batch.column("text"), n):
                size = np.diff(at)
                full = np.flatnonzero(size)
                first = at[:-1][full]
                values = np.zeros((len(size), hashes), np.uint32)
                keys = np.zeros((2, len(size)), U64)
                if len(full):
                    for j in range(hashes):
                        values[full, j] = np.minimum.reduceat(((grams * factor[j] + shift[j]) >> U64(32)).astype(np.uint32), first)
                    for j in range(2):
                        keys[j, full] = np.add.reduceat(mixed(grams + U64(j * 977 + 1)), first)
                cuts = pa.array(np.arange(len(size) + 1, dtype=np.int32) * hashes * 4)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(size)), pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.array(size.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(size), [None, cuts.buffers()[1], pa.py_buffer(values.tobytes())])], names=["doc_id", "k1", "k2", "size", "mins"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(signed_rows, "doc_id long, k1 long, k2 long, size long, mins binary"), "signatures")


def by_unit(rows: DataFrame, unit: list[str], schema: str, work: Callable[[dict[str, list]], Iterator[tuple]]) -> DataFrame:
    """work(columns of a unit's rows) for each unit; a unit's rows meet in one task, one unit after another. work yields rows of schema (longs)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        now = None
        out: list[tuple] = []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in unit), strict=True))
            cols = {c: batch.column(c) for c in batch.schema.names if c not in unit}
            begin = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[begin]:
                    continue
                if keys[begin] != now:
                    if now is not None:
                        out += work(held)
                    now, held = keys[begin], {c: [] for c in cols}
                for c, col in cols.items():
                    held[c] += col.slice(begin, k - begin).to_pylist()
                begin = k
            if len(out) > 10_000:
                yield done()
                out.clear()
        if now is not None:
            out += work(held)
        if out:
            yield done()

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(units, schema)


def in_blocks(rows: DataFrame, count: str, key: str, block: int) -> DataFrame:
    """rows with unit numbers i <= j and the side they take: a group of up to `block` rows is one unit, a larger one has a unit for each two blocks."""
    n = F.ceil(F.col(count) / F.lit(block))
    own = F.pmod(F.xxhash64(F.lit(5), key), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"), (own > k).cast("int").alias("side")))
    return rows.withColumn("unit", F.explode(pairs)).select("*", "unit.i", "unit.j", "unit.side", (F.col("unit.i") == F.col("unit.j")).alias("same")).drop("unit")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node the least node that links lead to. linked: a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _whole(part: np.ndarray, first: np.ndarray, second: np.ndarray, same: bool) -> np.ndarray:
    """The symmetric matrix of a unit from that of its two sides."""
    if same:
        part = part | part.T
        np.fill_diagonal(part, False)
        return part
    n = len(first)
    out = np.zeros((n + len(second),) * 2, bool)
    out[:n, n:], out[n:, :n] = part, part.T
    return out


def _likely(unit: dict[str, list], least: int) -> Iterator[tuple]:
    side = np.array(unit["side"])
    rep = np.array(unit["rep"])
    mins = np.frombuffer(b"".join(unit["mins"]), np.uint32).reshape(len(rep), -1)
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    same = unit["same"][0]
    if len(first) < 1 + same or not (same or len(second)):
        return
    a, b = mins[first], mins[first if same else second]
    agree = np.zeros((len(a), len(b)), np.uint16)
    for k in range(mins.shape[1]):
        agree += a[:, k, None] == b[None, :, k]
    label = forest(_whole(agree >= least, first, second, same))
    ids = rep[first] if same else np.concatenate([rep[first], rep[second]])
    for k in np.flatnonzero(label != np.arange(len(label))):
        yield int(ids[k]), int(ids[label[k]])


def shared_grams(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share."""
    every = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        present = np.zeros((len(a) + len(b), 2048), np.float32)
        present[owner[lo:hi], column[lo:hi] - at] = 1
        out += present[: len(a)] @ present[len(a) :].T
    return out


def _verified(unit: dict[str, list], threshold: float) -> Iterator[tuple]:
    """(representative, root of the forest, weight of its links in this unit)."""
    once = np.unique(unit["rep"], return_index=True)[1]  # repeated rows of a document
    sets = [np.frombuffer(unit["grams"][k], U64) for k in once]
    side, rep, weight = (np.array(unit[c])[once] for c in ("side", "rep", "weight"))
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = unit["same"][0]
    if len(first) < 1 + same or not (same or len(second)):
        return
    other = first if same else second
    a, b = [sets[k] for k in first], [sets[k] for k in other]
    common = shared_grams(a, b)
    total = np.array([len(x) for x in a], np.float64)[:, None] + np.array([len(x) for x in b], np.float64)
    part = common / (total - common) >= threshold
    if same:
        np.fill_diagonal(part, False)
    linked = _whole(part, first, other, same)
    ids = rep[first] if same else np.concatenate([rep[first], rep[second]])
    heavy = weight[first] if same else np.concatenate([weight[first], weight[second]])
    links = linked.astype(np.int64) @ heavy
    label = forest(linked)
    for k in np.flatnonzero(links):
        yield int(ids[k]), int(ids[label[k]]), int(links[k])


def join(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """doc_id, class_id, n_links of docs' doc_id and text."""
    bands, rows, least = shape_for(threshold, recall, hashes)
    found = signatures(docs, n, hashes)
    whole = found.where("doc_id is not null")
    # copies are counted before values travel
    members = whole.where("size > 0").select("doc_id", "k1", "k2").distinct()
    reps = written(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")), "representatives")
    values = written(whole.join(reps.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]).select("k1", "k2", F.xxhash64("k1", "k2").alias("rep"), "mins"), "values")
    band = lambda k: F.xxhash64(F.lit(k), F.substring("mins", 4 * rows * k + 1, 4 * rows))
    placed = values.select("rep", F.explode(F.array(*(band(k) for k in range(bands)))).alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    candidates = placed.join(full, "bucket").join(values.select("rep", "mins"), "rep")
    likely = by_unit(in_blocks(candidates, "n", "rep", BLOCK), ["bucket", "i", "j"], "a long, b long", lambda unit: _likely(unit, least))
    groups = components(likely)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    picked = written(groups.join(sizes, "component").withColumnRenamed("node", "rep").join(reps.withColumn("id", F.col("rep")).withColumn("rep", F.xxhash64("k1", "k2")), "rep"), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = with_sets(texts.join(picked.hint("shuffle_hash"), "id"), n)
    checked = written(by_unit(in_blocks(sets, "n", "rep", VERIFY_BLOCK), ["component", "i", "j"], "rep long, root long, links long", lambda unit: _verified(unit, threshold)), "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.withColumn("id", F.col("rep")).withColumn("rep", F.xxhash64("k1", "k2")).join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = written(known.select("k1", "k2", "id", "weight", "links", F.coalesce("component", "rep").alias("component")), "classes")
    heads = known.groupBy("component").agg(F.min("id").alias("class_id"))
    known = known.join(heads, "component").select("k1", "k2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = members.join(known, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    alone = found.where("doc_id is null or size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    return linked.unionByName(alone)


def with_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows of candidates, with their n-gram sets in the place of their texts; rows whose set isn't the one they are named by are left out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams, at in gram_sets(batch.column("text"), n):
                size = np.diff(at)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                first = at[:-1][full]
                keys = [signed(np.add.reduceat(mixed(grams + U64(j * 977 + 1)), first)) for j in range(2)]
                own = [np.asarray(batch.column(c).slice(row, len(size)))[full] for c in ("k1", "k2")]
                keep = full[(keys[0] == own[0]) & (keys[1] == own[1])]
                part = batch.slice(row, len(size)).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "component", "n", "weight")), pa.array([grams[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], names=["rep", "component", "n", "weight", "grams"])

    out = rows.select("rep", "component", "n", "weight", "k1", "k2", "text").mapInArrow(sets, "rep long, component long, n long, weight long, grams binary")
    return out


#: Exact similarities of all pairs that share an n-gram, and components by recursion: right for any table, for small ones only in time.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8),
  links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reached(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
  classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM classes LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
