"""Language-model scores by subword lattices: a text's marginal probability over all its segmentations.

The vocabulary is a public tokenizer's unigram one: its pieces and their scores (never trained here). Where the scores are mere ranks, as in vocabularies
of merges, a piece's first weight is 1 / (rank + 10). A word, with a mark before it for the space, is a lattice: every piece that matches some of its
bytes is an arc, and each single byte has an arc of its own, so nothing is out of vocabulary. The forward recursion in log space sums all paths. Only
the first piece of a word has a mark, so the next mark ends it, and the probabilities of all words sum to at most one; pieces don't cross
words, so a text's log probability is the sum over its words and one end.

The weights are re-estimated on the words of all training texts by expectation maximisation (`rounds` times), with the exact posterior counts of forward and backward
recursions, each word as often as it occurs. That is done for classes of training texts: the `classes` most frequent languages, one class for all other
texts, and one for all texts together, whose counts are the sums of the others' and towards which those are smoothed. A text is a mixture
of all classes; its own language is never looked at, none is left out, and the sum is its marginal. So scores are probabilities: over all texts they sum to at most one.

The base score is the add-one unigram score of the words.

Work is done once for each distinct word of the corpus: a table of words with their counts (combined before the shuffle) goes
through the recursions, in tasks, and only the sums for each piece and class (at most 32,000 times `classes` + 2 rows) go to the driver. Texts then need their words'
counts and scores. Words with at least 1/HEAD of all tokens are at most HEAD, by arithmetic, so those are broadcast; a document's other words
are joined as rows (one a word, with its prices in all classes), and none of them can be a hot key, since each has less than 1/HEAD of all tokens.

Nulls: a null text counts as empty: no words, one end. A null doc_id counts as an empty text for the fold and stays null. Repeated rows are each
counted, scored and returned; ties (languages as frequent as each other) go by name. Without training rows every count is 0 and the pieces keep the vocabulary's order. An
empty table gives no rows. Other columns are left out. A very long word is one lattice like others, worked on in runs of PART bytes that pass their borders' values on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE_WORDS, U64, lowered, powers, signed, slices, split_of, table, word_hashes, words, written

FOLDS, HELD_OUT = 7, 2
VOCABULARY = "piece_bpe_32k.model"
HEAD, ROUNDS, PART = 200_000, 3, 512
CLASSES = 6
#: Added to each piece's expected count, so that unseen pieces keep some weight; counts by which a class is drawn to the weights of all texts.
PRIOR, DRAWN = 0.02, 2000.0
_CELLS = 1 << 19


class Pieces:
    """A vocabulary's pieces as bytes (a space for the mark), found by the hash of a run of bytes."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(U64) + U64(1)
        size = np.array([len(p) for p in pieces])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        self.hash = np.add.reduceat(data * _place(int(size.max()))[np.arange(len(data)) - np.repeat(first, size)], first)
        self.tables = []
        left, salt = np.arange(len(pieces)), 1
        while len(left):
            salt += 2
            slots = np.full(1 << 18, -1, np.int32)
            at = self._slot(self.hash[left], salt)
            slots[at] = left
            self.tables.append((salt, slots))
            left = left[slots[at] != left]

    @staticmethod
    def _slot(h: np.ndarray, salt: int) -> np.ndarray:
        return ((h ^ (h >> U64(29))) * U64((0x9E3779B97F4A7C15 * salt) & ((1 << 64) - 1)) >> U64(46)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for salt, slots in self.tables:
            got = slots[self._slot(h, salt)]
            hit = (got >= 0) & (self.hash[got] == h)
            out[hit] = got[hit]
        return out


def _place(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, U64), powers(n)[: n - 1])) if n else np.zeros(0, U64)


_BACK = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _unplace(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, U64), np.multiply.accumulate(np.full(max(0, n - 1), _BACK, U64))))[:n]


@lru_cache(2)
def vocabulary(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))])


class Weights:
    """Log weights of pieces and of the 256 bytes."""

    def __init__(self, counts: np.ndarray):
        logs = np.log(counts / counts.sum())
        self.piece, self.byte = logs[:-256], logs[-256:]

    @staticmethod
    def first(pieces: Pieces) -> Weights:
        n = len(pieces.pieces)
        return Weights(np.concatenate([1 / (np.arange(n) + 10.0), np.full(256, 1e-4)]))


@lru_cache(4096)
def _spans(size: int, longest: int):
    """Begin and end of every arc over size bytes, by end; where each end's arcs begin; and the arcs by begin, likewise."""
    pairs = np.array([(j - k, j) for j in range(1, size + 1) for k in range(1, min(j, longest) + 1)])
    begin, end = pairs[:, 0], pairs[:, 1]
    by_begin = np.lexsort((end, begin))
    return begin, end, np.searchsorted(end, np.arange(size + 2)), by_begin, np.searchsorted(begin[by_begin], np.arange(size + 1))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return np.log(np.exp(x - top[:, None]).sum(1)) + top


def _matched(x: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece of each arc (-1: none) for words x (one a row) of the same size."""
    size = x.shape[1]
    h = np.zeros((len(x), size + 1), U64)
    np.cumsum((x.astype(U64) + U64(1)) * _place(size), axis=1, out=h[:, 1:])
    return pieces.find((h[:, end] - h[:, begin]) * _unplace(size)[begin])


def _logs(x: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray, weights: Weights) -> np.ndarray:
    """Log weight of each arc."""
    log = np.where(found >= 0, weights.piece[found], -np.inf)
    single = np.flatnonzero(end - begin == 1)
    log[:, single] = np.logaddexp(log[:, single], weights.byte[x[:, begin[single]]])
    return log


def _alpha(log: np.ndarray, begin: np.ndarray, by_end: np.ndarray, size: int) -> np.ndarray:
    alpha = np.zeros((len(log), size + 1))
    for j in range(1, size + 1):
        at = slice(by_end[j], by_end[j + 1])
        alpha[:, j] = _log_sum(alpha[:, begin[at]] + log[:, at])
    return alpha


def forward(x: np.ndarray, pieces: Pieces, weights: list[Weights]) -> np.ndarray:
    """Log probabilities of words x of the same size, each with its mark, under each of weights."""
    n, size = x.shape
    if size > PART:
        return np.array([[_alpha_long(row, pieces, w)[-1] for w in weights] for row in x])
    begin, end, by_end, _, _ = _spans(size, pieces.longest)
    found = _matched(x, begin, end, pieces)
    return np.stack([_alpha(_logs(x, begin, end, found, w), begin, by_end, size)[:, size] for w in weights], 1)


def _alpha_long(x: np.ndarray, pieces: Pieces, weights: Weights) -> np.ndarray:
    """The forward values of one long word, by runs of PART ends."""
    m, n = pieces.longest, len(x)
    alpha = np.zeros(n + 1)
    for done in range(0, n, PART):
        lo, hi = max(0, done - m), min(n, done + PART)  # arcs into this run begin at lo or later
        begin, end, by_end, _, _ = _spans(hi - lo, m)
        log = _logs(x[None, lo:hi], begin, end, _matched(x[None, lo:hi], begin, end, pieces), weights)[0]
        for j in range(done - lo + 1, hi - lo + 1):
            at = slice(by_end[j], by_end[j + 1])
            alpha[lo + j] = _log_sum((alpha[lo + begin[at]] + log[at])[None])[0]
    return alpha


def _add(share: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray, log: np.ndarray, weights: Weights, pieces: Pieces, into: np.ndarray) -> None:
    """Adds the arcs' posterior counts to those of pieces and bytes."""
    single = np.flatnonzero(end - begin == 1)
    letters = x[:, begin[single]]
    by_byte = share[:, single] * np.exp(weights.byte[letters] - log[:, single])
    share[:, single] -= by_byte
    into[: len(pieces.pieces)] += np.bincount(found[found >= 0], share[found >= 0], len(pieces.pieces))
    into[-256:] += np.bincount(letters.ravel(), by_byte.ravel(), 256)


def expected(x: np.ndarray, times: np.ndarray, pieces: Pieces, weights: list[Weights], into: np.ndarray) -> None:
    """Adds the expected counts of pieces and bytes in words x to into (a row a class). times: how often each word occurs in each class."""
    n, size = x.shape
    if size > PART:
        for row, own in zip(x, times, strict=True):
            for k in np.flatnonzero(own):
                _expected_long(row, float(own[k]), pieces, weights[k], into[k])
        return
    begin, end, by_end, by_begin, starts = _spans(size, pieces.longest)
    found = _matched(x, begin, end, pieces)
    for k, own in enumerate(weights):
        rows = np.flatnonzero(times[:, k])
        if not len(rows):
            continue
        f, words = found[rows], x[rows]
        log = _logs(words, begin, end, f, own)
        alpha, beta = _alpha(log, begin, by_end, size), np.zeros((len(rows), size + 1))
        for i in range(size - 1, -1, -1):
            at = by_begin[starts[i] : starts[i + 1]]
            beta[:, i] = _log_sum(beta[:, end[at]] + log[:, at])
        share = np.exp(alpha[:, begin] + log + beta[:, end] - alpha[:, size:]) * times[rows, k][:, None]
        _add(share, words, begin, end, f, log, own, pieces, into[k])


def _expected_long(x: np.ndarray, times: float, pieces: Pieces, weights: Weights, into: np.ndarray) -> None:
    """The same for one long word, by runs of PART begins from its end."""
    m, n = pieces.longest, len(x)
    alpha, beta = _alpha_long(x, pieces, weights), np.zeros(n + 1)
    for lo in range((n - 1) // PART * PART, -1, -PART):
        part = x[None, lo : min(n, lo + PART + m)]
        begin, end, _, by_begin, starts = _spans(part.shape[1], m)
        found = _matched(part, begin, end, pieces)
        log = _logs(part, begin, end, found, weights)
        for i in range(min(PART, n - lo) - 1, -1, -1):
            at = by_begin[starts[i] : starts[i + 1]]
            beta[lo + i] = _log_sum((beta[lo + end[at]] + log[0, at])[None])[0]
        share = np.where(begin < PART, np.exp(alpha[lo + begin] + log + beta[lo + end] - alpha[n]), 0.0) * times
        _add(share, part, begin, end, found, log, weights, pieces, into)


def _by_size(column: pa.Array):
    """(rows, words with their mark as a matrix) of words of the same size, in parts of bounded work."""
    _, data, offsets = next(slices(column.cast(pa.large_binary()).view(pa.large_string()), 1 << 62))
    size = np.diff(offsets)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, _CELLS // (int(n + 1) * 16))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            x = np.full((len(part), n + 1), 0x20, np.uint8)
            x[:, 1:] = data[offsets[part][:, None] + np.arange(n)]
            yield part, x


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    flat = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])


def word_table(docs: DataFrame, classes: int) -> DataFrame:
    """Rows h, word, n, c, c1, c2, ... (all its tokens; those in training rows; those in training rows of each class) of docs' text, train and class
    (0: none), as a stored table."""
    sums = ["n", "c", *(f"c{k}" for k in range(1, classes + 1))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.where(np.asarray(batch.column("train"), dtype=bool), np.asarray(batch.column("class"), dtype=np.int64), -1) if batch.num_rows else np.zeros(0, np.int64)
            parts: list[tuple] = []
            for row, data, offsets in slices(batch.column("text")):
                data = lowered(data)
                starts, ends, at = words(data, offsets, SPACE_WORDS)
                h, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                own = np.repeat(kind[row : row + len(at) - 1], np.diff(at))
                parts.append((h, word_array(data, starts[first], ends[first]), np.bincount(inverse, minlength=len(h)), np.bincount(inverse, own >= 0, len(h)), *(np.bincount(inverse, own == k, len(h)) for k in range(1, classes + 1))))
            if not parts:
                continue
            h, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            text = pa.concat_arrays([p[1] for p in parts]).take(pa.array(first))
            total = (np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(h)).astype(np.int64) for k in range(2, 2 + len(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), text, *map(pa.array, total)], names=["h", "word", *sums])

    rows = docs.select("text", "train", "class").mapInArrow(counted, "h long, word binary, " + ", ".join(f"{c} long" for c in sums))
    return written(rows.groupBy("h", "word").agg(*(F.sum(c).alias(c) for c in sums)), "words")


def fit(table_of_words: DataFrame, path: str, classes: int, rounds: int = ROUNDS) -> list[Weights]:
    """Weights of all texts and of each class, after rounds of expectation maximisation over the training words."""
    spark = table_of_words.sparkSession
    pieces = vocabulary(path)
    weights = [Weights.first(pieces)] * (classes + 1)
    names = [f"c{k}" for k in range(1, classes + 1)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def counted(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = vocabulary(path)
            into = np.zeros((classes, len(own.pieces) + 256))
            for batch in batches:
                times = np.stack([np.asarray(batch.column(c), dtype=float) for c in names], 1)
                for rows, x in _by_size(batch.column("word")) if batch.num_rows else ():
                    expected(x, times[rows], own, sent.value[1:], into)
            k, used = np.nonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(used), pa.array(into[k, used])], names=["class", "piece", "count"])

        rows = table_of_words.where("c > 0").select("word", *names).mapInArrow(counted, "class long, piece long, count double").groupBy("class", "piece").agg(F.sum("count").alias("count")).collect()
        if not rows:
            return weights
        found = np.zeros((classes, len(pieces.pieces) + 256))
        for r in rows:
            found[r[0], r[1]] = r[2]
        every = found.sum(0) + PRIOR
        weights = [Weights(every), *(Weights(own + DRAWN * every / every.sum()) for own in found)]
    return weights


def priced(table_of_words: DataFrame, weights: list[Weights], path: str, end: float) -> DataFrame:
    """h, n, c and log10 probabilities p0, p1, ... of every word in all texts and in each class, as a stored table. end: probability of the end."""
    sent = table_of_words.sparkSession.sparkContext.broadcast(weights)
    names = ["h", "n", "c", *(f"p{k}" for k in range(len(weights)))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names) - 3))
            for rows, x in _by_size(batch.column("word")) if batch.num_rows else ():
                out[rows] = forward(x, own, sent.value)
            out = (out + np.log1p(-end)) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), batch.column("c"), *map(pa.array, out.T.copy())], names=names)

    return written(table_of_words.mapInArrow(scored, "h long, n long, c long, " + ", ".join(f"{c} double" for c in names[3:])), "priced")


def scores(docs: DataFrame, path: str, head: int = HEAD, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs' doc_id, text, held_out (and lang, if there)."""
    spark = docs.sparkSession
    docs = docs.withColumn("train", ~F.col("held_out"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("train").groupBy(lang.alias("lang")).count().collect()
    training_rows = sum(r["count"] for r in texts)
    top = sorted((r for r in texts if r["lang"] is not None), key=lambda r: (-r["count"], r["lang"]))[:classes]
    number = F.create_map(*(F.lit(x) for k, r in enumerate(top, 1) for x in (r["lang"], k))) if top else None
    # the languages beyond the first ones, and texts without one, are a class, too
    others = len(top) + 1
    docs = docs.withColumn("class", F.coalesce(F.element_at(number, lang), F.lit(others)) if top else F.lit(others))
    found = word_table(docs, others)
    sums = found.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    train_tokens = (sums["c"] or 0) + training_rows
    scale = float(np.log10(train_tokens + sums["distinct"] + bool(training_rows) + 1))
    end = (training_rows + 1) / (train_tokens + 2)
    prices = priced(found, fit(found, path, others, rounds), path, end)
    columns = [f"p{k}" for k in range(others + 1)]
    often = sorted(tuple(r) for r in prices.where(F.col("n") * head >= (sums["n"] or 0)).select("h", "c", *columns).collect())
    # prior shares of the classes: a twentieth for that of all texts, the rest by their numbers of texts
    own = np.array([*(r["count"] for r in top), training_rows - sum(r["count"] for r in top)], float) + 0.5
    share = np.append(0.05, 0.95 * own / own.sum())
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in often], np.int64), np.array([r[1] for r in often], np.int64), np.array([r[2:] for r in often], float).reshape(len(often), len(columns)), np.log10(share)))
    ends = (float(np.log10(training_rows + 1)), float(np.log10(end)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document: a row with what the broadcast words give in each class (times 0: it needs no other word), and one for each other word."""
        hashes, known, p, prior = sent.value
        logs = np.log10(known + 1.0)
        base = TaskContext.get().partitionId() << 40
        names = ["row", "h", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "parts"]
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                data = lowered(data)
                starts, ends_of, at = words(data, offsets, SPACE_WORDS)
                h = signed(word_hashes(data, starts, ends_of))
                n = len(at) - 1
                owner = np.repeat(np.arange(n), np.diff(at))
                k = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[k] == h if len(hashes) else np.zeros(len(h), bool)
                k, who = k[hit], owner[hit]
                parts = np.stack([np.bincount(who, p[k, j], n) for j in range(len(prior))], 1) + prior + ends[1]
                yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(n)), pa.array(signed((np.arange(n).astype(U64) + U64(base)) * U64(0x9E3779B97F4A7C15))), pa.array(np.zeros(n, np.int64)), batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n), pa.array(np.diff(at) + 1, pa.int64()), pa.array(np.bincount(who, known[k] > 0, n).astype(np.int64) + bool(training_rows), pa.int64()), pa.array(np.bincount(who, logs[k], n) + ends[0], pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(prior), pa.int32()), pa.array(parts.ravel()))], names=names)
                h, owner = h[~hit], owner[~hit]
                if len(h):
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    head_of = np.flatnonzero(new)
                    times = np.diff(np.append(head_of, len(h)))
                    h, owner = h[head_of], owner[head_of]
                    m = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(base + owner), pa.array(h), pa.array(times), *(pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=names)
                base += n

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(looked_up, "row long, h long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, parts array<double>")
    joined = rows.join(prices.select("h", "c", *columns), "h", "left")
    times = F.col("times")
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, times), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", times * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("base"),
        *(F.sum(F.coalesce(F.col("parts")[k], times * F.col(c))).alias(c) for k, c in enumerate(columns)),
    ).withColumn("parts", F.array(*columns))
    most = F.array_max("parts")
    score = most + F.log10(F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - most)))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (split_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    return scores(docs, public_tokenizers.path(VOCABULARY))
