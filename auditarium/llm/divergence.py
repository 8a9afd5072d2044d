"""Source divergence: how far the words of one source of a language are from those of each other source, and which words of a source stand out.

Groups are the (lang, source) pairs that occur. A language keeps the terms that at least `least` of its documents hold; a group gives each kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), in whole numbers, and differs from another group's (or the language's) q by floor((p - q)^2 / q).

Method, systolic rotation:
1. Texts become counts by (lang, source, term) where they are read, a slice at a time; Spark adds them up (partial sums go before the shuffle).
2. Terms are dealt to buckets by hash, as many as keep each bucket at `cells` counts on average, so a bucket is a bounded table whatever a source's
   size. There the terms that stay are numbered in UTF-8 order and each group's counts become one compressed vector, the language's another.
3. Sources of a language are dealt to seats, `seat` at a time. A seat's vectors of a bucket stay in one partition (the residents, persisted by seat; a lost one
   is rebuilt from the vectors' table) while peers' vectors come to it by the rounds of a round-robin tournament: seat i meets seat (r - i) mod (m - 1) in round
   r of m - 1, each two seats once. A meeting evaluates both directions. Before the rounds, a seat's own sources meet, and the language's vector visits
   every seat: there heaps of `top` entries rank each group's terms of a bucket, of which the best of all buckets remain.
4. Each round ends as a table; sums over buckets give the pairs.

A pair costs the terms that either source has: where both have none, f is one number. Whole results are kept: all pairs, all counts. Exactness: divisions by long division in base 1000 (N + V up to
9.2e15), squares below 2^63, and sums below 2^63 since a group's p sum to about SCALE.

Nulls: null text, lang or source count as ''. Empty texts and texts without letters still make their group occur, with a count of 0 for each kept term. Very long texts
are cut into words by one task and leave it as counts. Repeated rows are documents each. Ties rank by the UTF-8 order of the item. An empty table
gives no rows; a language without kept terms gives pairs of value 0. Other columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lowered, shared_dir, slices, table, words, written

SCALE = 1_000_000_000
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LEAST, TOP, CELLS, SEAT = 3, 200, 1 << 17, 8
#: Languages of several buckets that are broadcast (some 40 bytes each).
BROADCAST = 100_000
#: Bytes of text that are counted at once.
SLICE = 8 << 20


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)) of each count, digit by digit in base 1000, so that nothing leaves 64 bits."""
    d = total + kept
    whole, rest = np.divmod(counts + 1, d)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + digit
    return out + 1


def apart(p, q):
    """floor((p - q)^2 / q)."""
    step = p - q
    return step * step // q


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids and their counts, as differences in the narrowest type that holds them, deflated."""
    steps = np.diff(ids, prepend=0)
    kinds = [np.min_scalar_type(int(x.max()) if len(x) else 0) for x in (steps, counts)]
    return bytes([kinds[0].itemsize, kinds[1].itemsize]) + zlib.compress(steps.astype(kinds[0]).tobytes() + counts.astype(kinds[1]).tobytes(), 1)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not vector:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = zlib.decompress(vector[2:])
    n = len(body) // (vector[0] + vector[1])
    steps = np.frombuffer(body, f"u{vector[0]}", n).astype(np.int64)
    return np.cumsum(steps), np.frombuffer(body, f"u{vector[1]}", n, n * vector[0]).astype(np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents) of a slice of texts; term '' with zeros says that a group occurs."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        codes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
        seen = np.unique(codes)
        part = [(seen, pa.array([""] * len(seen)), np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64))]
        for row, data, offsets in slices(batch.column("text"), SLICE):
            data = lowered(data)
            starts, ends, begins = words(data, offsets, LETTERS)
            if not len(starts):
                continue
            lengths = ends - starts
            inside = data[LETTERS[data]]
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(inside)]).dictionary_encode()
            width = len(found.dictionary)
            doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            pair = np.sort(doc * width + found.indices.to_numpy())  # a document's words lie together
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            times = np.diff(first, append=len(pair))
            pair = pair[first]
            key = codes[row + pair // width] * width + pair % width
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            part.append((key[at] // width, found.dictionary.take(pa.array(key[at] % width)), np.add.reduceat(times, at), np.diff(at, append=len(key))))
        for group, term, n, d in part:
            if len(group):
                group = np.divmod(group, max(1, len(source.dictionary)))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group[0])).cast(pa.string()), source.dictionary.take(pa.array(group[1])).cast(pa.string()), pc.cast(term, pa.string()), pa.array(n), pa.array(d)], schema=_COUNTS)


def counts_of(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d of all documents, added up."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(_counted, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


_VECTORS = "lang string, bucket int, source string, size long, total long, vector binary, terms binary"


def _vectors(least: int):
    """A bucket's rows (source, term, n, d) as vectors: one for each source, and the language's (source null), which brings the terms."""

    def build(key, rows):
        term = rows.column("term").combine_chunks().cast(pa.large_binary()).dictionary_encode()
        source = rows.column("source").combine_chunks().dictionary_encode()
        code, who, n = term.indices.to_numpy(), source.indices.to_numpy(), rows.column("n").to_numpy()
        width = len(term.dictionary)
        documents, total = np.zeros(width, np.int64), np.zeros(width, np.int64)
        np.add.at(documents, code, rows.column("d").to_numpy())
        np.add.at(total, code, n)
        kept = np.flatnonzero(documents >= least)
        kept = kept[pc.array_sort_indices(term.dictionary.take(pa.array(kept))).to_numpy()] if len(kept) else kept
        number = np.full(width, -1, np.int64)
        number[kept] = np.arange(len(kept))
        held = number[code] >= 0
        who, ids, n = who[held], number[code[held]], n[held]
        order = np.lexsort((ids, who))
        who, ids, n = who[order], ids[order], n[order]
        names = term.dictionary.take(pa.array(kept))
        out = [(None, total[kept], packed(np.arange(len(kept)), total[kept]), zlib.compress(b"\0".join(names.to_pylist()), 1))]
        edges = np.searchsorted(who, np.arange(len(source.dictionary) + 1))
        out += [(s, n[a:b], packed(ids[a:b], n[a:b]), None) for s, a, b in zip(source.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True) if a < b]
        lang, bucket = (k.as_py() for k in key)
        size = len(out)
        return pa.table({
            "lang": pa.array([lang] * size, pa.string()), "bucket": pa.array([bucket] * size, pa.int32()), "source": pa.array([o[0] for o in out], pa.string()), "size": pa.array([len(kept)] * size, pa.int64()),
            "total": pa.array([int(o[1].sum()) for o in out], pa.int64()), "vector": pa.array([o[2] for o in out], pa.binary()), "terms": pa.array([o[3] for o in out], pa.binary()),
        })

    return build


def term_of(terms: bytes, ids: list[int]) -> list[str]:
    found = zlib.decompress(terms).split(b"\0")
    return [found[k].decode() for k in ids]


class _Vector:
    """A group's shares of one bucket: of the terms it has (ids), and of all others (none)."""

    def __init__(self, row: dict):
        self.source, self.total, self.kept = row["source"], row["n"], row["v"]
        self.ids, counts = unpacked(row["vector"])
        self.p = shares(counts, self.total, self.kept) if self.kept else counts
        self.none = int(shares(np.zeros(1, np.int64), self.total, self.kept)[0]) if self.kept else 1


def _meeting(a: _Vector, b: _Vector, dense: np.ndarray, size: int) -> tuple[int, int]:
    """Sums of f over a bucket's terms, a from b and b from a. dense: a's shares of all terms."""
    at_b = dense[b.ids]
    alone = np.ones(size, bool)
    alone[b.ids] = False
    alone = alone[a.ids]
    p, rest = a.p[alone], size - len(b.ids) - int(alone.sum())
    return (
        int(apart(at_b, b.p).sum()) + int(apart(p, b.none).sum()) + rest * apart(a.none, b.none),
        int(apart(b.p, at_b).sum()) + int(apart(b.none, p).sum()) + rest * apart(b.none, a.none),
    )


_MET = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_MET_SQL = "lang string, bucket int, source string, part string, item string, value long"


def _rows(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_MET), _MET, strict=True)], schema=_MET)


def _met(home: pa.Table, away: pa.Table | None, top: int) -> pa.Table:
    """All meetings of a seat's vectors with its guests'; without guests (round 0), of its own with each other, and ranks of terms by the language's vector."""
    if not home.num_rows or (away is not None and not away.num_rows):
        return _rows([])
    rows = home.to_pylist()
    lang, bucket, size = rows[0]["lang"], rows[0]["bucket"], rows[0]["size"]
    whole = [r for r in rows if r["source"] is None]
    own = sorted((_Vector(r) for r in rows if r["source"] is not None), key=lambda v: v.source)
    guests = None if away is None else [_Vector(r) for r in away.to_pylist()]
    out: list[tuple] = []
    for k, a in enumerate(own):
        dense = np.full(size, a.none, np.int64)
        dense[a.ids] = a.p
        for b in own[k + 1 :] if guests is None else guests:
            there, back = _meeting(a, b, dense, size)
            out += [(lang, bucket, a.source, "pair", b.source, there), (lang, bucket, b.source, "pair", a.source, back)]
        if guests is None and len(a.ids):
            q = _Vector(whole[0]).p[a.ids]
            values, more = apart(a.p, q), a.p > q
            ids = a.ids[more]
            best = heapq.nsmallest(top, zip((-values[more]).tolist(), ids.tolist(), strict=True))
            names = term_of(whole[0]["terms"], [i for _, i in best])
            out += [(lang, bucket, a.source, "term", name, -v) for (v, _), name in zip(best, names, strict=True)]
    return _rows(out)


def partner(r, i, m):
    """The seat that seat i meets in round r of m - 1 (m even): a column expression; m's last seat stays where the others turn."""
    turn = F.pmod(r - i, m - 1)
    return F.when(i == m - 1, F.pmod(r * F.floor(m / 2), m - 1)).when(turn == i, m - 1).otherwise(turn)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, cells: int = CELLS, seat: int = SEAT) -> DataFrame:
    """Rows lang, source, part (pair or term), item, value, rank: see the module's head. cells: counts in a bucket, on average; seat: sources that share a seat."""
    spark = docs.sparkSession
    counts = written(counts_of(docs), "counts")
    # as many buckets as a language's counts ask for
    sizes = counts.groupBy("lang").agg(F.ceil(F.count("*") / cells).cast("int").alias("buckets"))
    # only languages of several buckets need a look-up, and there is at most one for each `cells` counts; a shuffle by language would leave a task to each
    several = written(sizes.where("buckets > 1").withColumnRenamed("buckets", "own"), "buckets")
    several = F.broadcast(several) if several.count() <= BROADCAST else several
    dealt = counts.where("term <> ''").join(several, "lang", "left").select("lang", F.pmod(F.xxhash64("term"), F.coalesce("own", F.lit(1))).cast("int").alias("bucket"), "source", "term", "n", "d")
    vectors = written(dealt.groupBy("lang", "bucket").applyInArrow(_vectors(least), _VECTORS), "vectors")
    # groups: N, V and a seat for each source of a language
    kept = vectors.where("source is null").groupBy("lang").agg(F.sum("size").alias("v"), F.sum("total").alias("n_lang"))
    totals = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term = ''").select("lang", "source").withColumn("seat", F.floor(place / seat).cast("int")).join(totals, ["lang", "source"], "left").join(sizes, "lang").join(kept, "lang", "left")
    groups = written(groups.select("lang", "source", "seat", "buckets", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang")), "groups")
    seats = groups.groupBy("lang").agg((F.max("seat") + 1).alias("seats"))
    rounds = seats.agg(F.max("seats")).first()[0]
    if rounds is None:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    # residents: each group in each bucket, its vector or none; and the language's vector at each seat
    whole = vectors.where("source is null").select("lang", "bucket", "size", F.col("vector").alias("lv"), "terms")
    sizes_of = whole.select("lang", "bucket", "size")
    everywhere = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    own = everywhere.join(vectors.where("source is not null").select("lang", "bucket", "source", "vector"), ["lang", "bucket", "source"], "left").join(sizes_of, ["lang", "bucket"], "left")
    own = own.select("lang", "bucket", "seat", "source", F.coalesce("size", F.lit(0)).alias("size"), "n", "v", "vector")
    visits = everywhere.select("lang", "bucket", "seat", F.col("n_lang").alias("n"), "v").distinct().join(whole, ["lang", "bucket"]).select("lang", "bucket", "seat", F.lit(None).cast("string").alias("source"), "size", "n", "v", F.col("lv").alias("vector"), "terms")
    residents = written(own.withColumn("terms", F.lit(None).cast("binary")).unionByName(visits), "residents")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = residents.repartition(parts, "lang", "bucket", "seat").persist(StorageLevel.MEMORY_AND_DISK)
    out = shared_dir(spark, "meetings")
    try:
        home.groupBy("lang", "bucket", "seat").applyInArrow(lambda rows: _met(rows, None, top), _MET_SQL).write.option("compression", "zstd").parquet(out)
        turned = seats.withColumn("m", F.expr("seats + seats % 2"))
        travellers = residents.where("source is not null").drop("terms").join(turned, "lang")
        sources = home.where("source is not null")
        for r in range(rounds + rounds % 2 - 1):
            other = partner(F.lit(r), F.col("seat"), F.col("m"))
            # of two seats that meet, the higher one travels if their sum is even, else the lower one
            guests = travellers.where((F.lit(r) < F.col("m") - 1)).withColumn("to", other).where("to < seats").where(F.when((F.col("to") + F.col("seat")) % 2 == 0, F.col("seat") > F.col("to")).otherwise(F.col("seat") < F.col("to")))
            guests = guests.select(F.col("to").cast("int").alias("seat"), *(F.col(c).alias(c) for c in ("lang", "bucket", "source", "size", "n", "v", "vector")))
            sources.groupBy("lang", "bucket", "seat").cogroup(guests.groupBy("lang", "bucket", "seat")).applyInArrow(lambda a, b: _met(a, b, top), _MET_SQL).write.mode("append").option("compression", "zstd").parquet(out)
    finally:
        home.unpersist()
    met = spark.read.schema(_MET_SQL).parquet(out)
    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(met.where("part = 'term'").drop("bucket"))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", order).where(f"part = 'pair' or rank <= {int(top)}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = """WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(tot.n, 0) + v.v) AS p, 1 + (1000000000 * (k.c + 1)) // (v.n + v.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found) WHERE part = 'pair' OR rank <= 200"""
