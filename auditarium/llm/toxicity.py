"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, the beginnings of its words (so that forms of a word share
weight), pairs of neighbours, and pairs with one or two words left out between (skip-grams); all hashed to
2^bits places. Words are runs of letters, digits and non-ASCII bytes after A-Z became a-z.

Training: follow-the-regularised-leader, proximal, with a learning rate for each coordinate and L1, several passes over
a sample in the order of a hash. The sample is bounded by a parameter: at most about `per_class` rows of each label, picked by hash of the id; the
labels' ids are broadcast to find their texts, and that is bounded by the same parameter. Texts become feature numbers where they are read, so none travels; a very
long text has at most 2^bits features. Rates of sampling are put back into the intercept. The update is sequential by nature, so the bounded sample's numbers (flat
arrays) are one task's work, ordered by hash, label and length (ties are repeated rows), and the weights come back as one value.

Scoring: the non-zero weights (at most 2^bits) go to every task, which scores its rows without a shuffle.

Nulls: a null text counts as empty; labels with a null doc_id or toxic are left out; several labels of one document
count as the highest. An empty text gets the intercept's score. With no usable labels every score is 0.0. Repeated document rows are each returned.
An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM_WORDS, U64, gram_hashes, lowered, mixed, slices, split_of, table, word_hashes, words

FOLDS, HELD_OUT = 5, 0


@dataclass(frozen=True)
class Settings:
    bits: int = 22
    prefix: int = 4
    skips: tuple[int, ...] = (1, 2)
    per_class: int = 12_000
    passes: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


def features(column: pa.Array, own: Settings):
    """(first row, features, where each row's features begin) of runs of rows; a feature may come more than once, and a row's are not sorted."""
    for row, data, offsets in slices(column):
        data = lowered(data)
        starts, ends, at = words(data, offsets, ALNUM_WORDS)
        h = word_hashes(data, starts, ends)
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        kinds = [(h, rows), (word_hashes(data, starts, np.minimum(ends, starts + own.prefix)) ^ U64(0x5BD1E995), rows)]
        if len(h) > 1:
            same = rows[1:] == rows[:-1]
            kinds.append((gram_hashes(h, 2)[same], rows[:-1][same]))
        for s in own.skips:
            if len(h) > s + 1:
                same = rows[s + 1 :] == rows[: -s - 1]
                kinds.append((mixed(h[: -s - 1] * U64(2 * s + 3) + (h[s + 1 :] >> U64(1)))[same], rows[: -s - 1][same]))
        found = np.concatenate([k for k, _ in kinds])
        owner = np.concatenate([r for _, r in kinds])
        yield row, (found >> U64(64 - own.bits)).astype(np.int64), owner, len(at) - 1


class FTRL:
    """Weights by place; place 2^bits is the intercept."""

    def __init__(self, own: Settings):
        self.own = own
        self.z, self.n = np.zeros((1 << own.bits) + 1), np.zeros((1 << own.bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        own, z = self.own, self.z[at]
        return np.where(np.abs(z) <= own.l1, 0.0, (np.sign(z) * own.l1 - z) / ((own.beta + np.sqrt(self.n[at])) / own.alpha + own.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.own.alpha * w
        self.n[at] = n + g * g


def packed(places: np.ndarray, bits: int) -> bytes:
    """Sorted places in two bytes each: how many have each high part, then their low 16 bits."""
    return np.bincount(places >> 16, minlength=1 << max(0, bits - 16)).astype(np.uint32).tobytes() + (places & 0xFFFF).astype(np.uint16).tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    high = 1 << max(0, bits - 16)
    return np.repeat(np.arange(high) << 16, np.frombuffer(data, np.uint32, high)) | np.frombuffer(data, np.uint16, offset=4 * high)


def sample(docs: DataFrame, labels: DataFrame, own: Settings) -> tuple[DataFrame, float]:
    """Rows text, toxic, key for training, and what the intercept needs for having sampled."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = {k: min(1.0, own.per_class / n) for k, n in counts.items()}
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * (1 << 24))
    # an id may have many rows: equal ones count once, and of others rows are drawn again, by id and text
    rows = docs.join(F.broadcast(picked), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("key"))
    texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.approx_count_distinct("key").alias("n")).collect()}
    again = {k: min(1.0, 1.2 * own.per_class / max(1, n)) for k, n in texts.items()}
    if min(again.values(), default=1.0) < 1:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < F.when(F.col("toxic") == 1, again.get(1, 1.0)).otherwise(again.get(0, 1.0)) * (1 << 24))
    return rows.dropDuplicates(["key"]), float(np.log(share.get(1, 1.0) / share.get(0, 1.0)))


def fit(docs: DataFrame, labels: DataFrame, own: Settings | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and values of the non-zero weights, from docs' doc_id and text and labels' doc_id and toxic; None without labels."""
    own = own or Settings()
    rows, shift = sample(docs, labels, own)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, owner, n in features(batch.column("text"), own):
                both = np.unique((owner << own.bits) | found)
                cuts = np.searchsorted(both, np.arange(n + 1) << own.bits)
                flat = (both & ((1 << own.bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, n), batch.column("toxic").slice(row, n), pa.array([packed(flat[a:b], own.bits) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["key", "toxic", "places"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, toxic, parts = [], [], []
        for batch in batches:
            keys.append(np.asarray(batch.column("key")))
            toxic.append(np.asarray(batch.column("toxic")))
            parts += batch.column("places").to_pylist()
        if not parts:
            return
        keys, toxic, size = np.concatenate(keys), np.concatenate(toxic), np.array(list(map(len, parts)))
        model = FTRL(own)
        order = np.lexsort((size, toxic, keys))
        for _ in range(own.passes):
            for k in order.tolist():
                model.learn(np.append(unpacked(parts[k], own.bits), 1 << own.bits), float(toxic[k]))
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype(np.int32).tobytes()], pa.binary()), pa.array([w[kept].tobytes()], pa.binary())], names=["places", "weights"])

    found = rows.mapInArrow(hashed, "key long, toxic int, places binary").repartition(1).mapInArrow(trained, "places binary, weights binary").first()
    if found is None:
        return None
    places, weights = np.frombuffer(found["places"], np.int32).astype(np.int64), np.frombuffer(found["weights"], np.float64).copy()
    if not len(places) or places[-1] != 1 << own.bits:
        places, weights = np.append(places, 1 << own.bits), np.append(weights, 0.0)
    weights[-1] -= shift
    return places, weights


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, own: Settings | None = None) -> DataFrame:
    """docs' doc_id and text (and held_out, if there) with score."""
    own = own or Settings()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in ("doc_id", "held_out") if c in docs.columns]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value is not None:
            weight = np.zeros((1 << own.bits) + 1)
            weight[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if sent.value is not None:
                for row, found, owner, n in features(batch.column("text"), own):
                    use = weight[found] != 0
                    both = np.unique((owner[use] << own.bits) | found[use])  # each feature counts once a text
                    total = np.bincount(both >> own.bits, weight[both & ((1 << own.bits) - 1)], n) + weight[-1]
                    out[row : row + n] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], names=[*kept, "score"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(scored, f"{schema}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = split_of("doc_id", FOLDS) == HELD_OUT
    # labels of held-out documents are left out before anything is counted or sampled
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = fit(docs.where(~held_out), labels)
    return score(docs.withColumn("held_out", held_out), model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
