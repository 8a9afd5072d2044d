"""Embedding whitening: statistics of all vectors by Chan's pairwise merging, components on the driver, a second pass that verifies the identity.

Entries become whole numbers x = floor(STEP * c) + OFFSET. Each partition computes a count, the exact sums of x, its own mean and the scatter around that mean; two such
summaries a and b make one by M = Ma + Mb + d d' na nb / (na + nb), where d is the difference of their means. So nothing is squared before it is centred, which
sums of squares of numbers near OFFSET would not survive. Summaries meet in treeReduce, `FAN` at a time, so the driver gets a few matrices of dim x dim whatever the
number of partitions; eigh runs there, and eigenvectors (dim x `components` numbers) go back to the tasks. Components have falling eigenvalues; of a vector and its
opposite the one whose largest entry is positive is taken. The second pass summarises the whitened vectors in the same way: `identity_error` is the largest entry
of their covariance minus the identity.

Nulls: rows whose vector is null, empty, or has a null or non-finite entry are left out; a null vec_id stays. Repeated rows count and are returned each time. Vectors of different lengths
raise ValueError, as do entries whose x or whose deviation does not fit 64 bits. A component without variance (fewer distinct vectors than dimensions) has whitened null and explained
0, and is left out of identity_error. Of equal eigenvalues any basis is taken, the same for all rows. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

STEP, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Summaries that meet in one task of treeReduce, and vectors that are worked on at once.
FAN, BLOCK = 8, 4096
#: Share of the largest eigenvalue below which a component counts as one without variance.
NOTHING = 1e-13


class Summary(NamedTuple):
    """n vectors: sums (exact, where x are whole numbers), mean, and scatter around the mean."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray


def summary(x: np.ndarray) -> Summary:
    """Of a block of vectors; whole numbers are first centred on their own first row, exactly, so that the mean has full precision."""
    base = x[0]
    near = (x - base).astype(np.float64)
    mean = near.mean(0)
    near -= mean
    sums = x.astype(object).sum(0) if x.dtype == np.int64 else x.sum(0)
    return Summary(len(x), sums, base + mean, near.T @ near)


def merged(a: Summary, b: Summary) -> Summary:
    """Chan's formula. Means of whole numbers are taken from exact sums, relative to a's, so that their difference isn't one of rounded large numbers."""
    n = a.n + b.n
    if a.sums.dtype == object:
        step = np.array([(sb * a.n - sa * b.n) / (a.n * b.n) for sa, sb in zip(a.sums, b.sums, strict=True)])
    else:
        step = b.mean - a.mean
    return Summary(n, a.sums + b.sums, a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))


def rows_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors (as whole numbers x) of a batch's rows that count."""
    column = batch.column("embedding")
    values = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
    bad = ~np.isfinite(flat)  # nulls become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[row[bad]] = False
    sizes = np.unique(lengths[good])
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries")
    picked = flat[good[row]].reshape(int(good.sum()), -1) if good.any() else np.zeros((0, 0))
    scaled = np.floor(picked * STEP)
    if scaled.size and np.abs(scaled).max() >= 2**62:
        raise ValueError("an entry is too large for 64 bits")
    return batch.column("vec_id").filter(pa.array(good)), scaled.astype(np.int64) + OFFSET


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _reduced(parts: DataFrame) -> Summary | None:
    """One summary of all partitions' ones (column s), FAN at a time in each step of the tree."""
    rdd = parts.rdd.map(lambda r: pickle.loads(r["s"]))
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), FAN)))
    found = rdd.map(lambda s: (s,)).treeReduce(_join, depth) if rdd.getNumPartitions() else ()
    return found[0] if found else None


def _join(a: tuple, b: tuple) -> tuple:
    """Of two summaries, either of which may be missing."""
    if not a or not b or a[0] is None or b[0] is None:
        return a if a and a[0] is not None else b
    if len(a[0].mean) != len(b[0].mean):
        raise ValueError(f"vectors of {len(a[0].mean)} and of {len(b[0].mean)} entries")
    return (merged(a[0], b[0]),)


def _partition(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The summary of a partition's blocks as one row; a partition without vectors has one of none."""
    total: tuple = (None,)
    for x in blocks:
        for at in range(0, len(x), BLOCK):
            total = _join(total, (summary(x[at : at + BLOCK]),))
    yield pa.RecordBatch.from_pydict({"s": pa.array([pickle.dumps(total[0])], pa.binary())})


class Whitening(NamedTuple):
    n: int
    sums: list
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    none: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; NaN in components without variance. x - S / n is taken as (x - base) - (S - n base) / n, of small exact numbers."""
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, base, strict=True)])
        near = (x - np.array(base, np.int64)).astype(np.float64) - rest
        return near @ self.vectors / np.where(self.none, np.nan, np.sqrt(np.where(self.none, 1.0, self.values)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n x - S)^2, exact."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - int(b) * self.n for s, b in zip(self.sums, base, strict=True)]
        far = x - base
        most = int(np.abs(far).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 2**63:
            near = far * self.n - np.array(rest, np.int64)
            return (near * near).sum(1)
        near = far.astype(object) * self.n - np.array(rest, object)
        found = (near * near).sum(1)
        if max(found) >= 2**63:
            raise ValueError("a deviation is too large for 64 bits")
        return found.astype(np.int64)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors (vec_id, embedding); None of none."""
    total = _reduced(_vectors(rows).mapInArrow(lambda batches: _partition(rows_of(b)[1] for b in batches), "s binary"))
    if total is None:
        return None
    values, vectors = np.linalg.eigh(total.scatter / total.n)
    values, vectors = np.maximum(values[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitening(total.n, [int(s) for s in total.sums], vectors, values, float(np.trace(total.scatter) / total.n), values <= NOTHING * max(values[0], 1e-300))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The second pass: the largest entry of the whitened vectors' covariance minus the identity, over components with variance."""
    own = ~w.none
    if not own.any():
        return 0.0
    total = _reduced(_vectors(rows).mapInArrow(lambda batches: _partition(w.apply(x)[:, own] for _, x in map(rows_of, batches) if len(x)), "s binary"))
    return float(np.abs(total.scatter / total.n - np.eye(int(own.sum()))).max())


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_SQL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """A row for each vector and component."""
    k = len(w.values)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)
    explained[w.none] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = rows_of(batch)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                y, n = w.apply(part).ravel(), len(part)
                own = ids.slice(at, n).take(pa.array(np.repeat(np.arange(n), k)))
                columns = [own.cast(pa.int64()), np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, w.n), np.repeat(w.deviations(part), k), pa.array(y, mask=np.isnan(y)), np.tile(explained, n), np.full(n * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], schema=_OUT)

    return _vectors(rows).mapInArrow(run, _OUT_SQL)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of all vectors of rows (vec_id, embedding)."""
    w = fit(rows, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], _OUT_SQL)
    return transform(rows, w, identity_error(rows, w))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
