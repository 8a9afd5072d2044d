"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes (A-Z lower-cased) go through two gated recurrent layers, one in each direction; at every position the two states give the
probability of each language, and a document's probabilities are the means over its positions. Texts are cut
into windows of `window` bytes, so a long text is many columns of one matrix, all bytes count and memory is bounded. Before a window's first position each state
has run over the `context` bytes in front of it (for the way back, those behind it). Where a window's first state is not, to within `CLOSE`, the last one of the window before it, the window is
run again from that one, until all agree: so a document's probabilities are those of a run over the whole text.

Training uses a sample that is bounded by parameters, whatever the corpus: at most `per_language` windows of each
language and `sample` in all (each cut out where the documents are read, so whole texts never travel), and the `max_languages`
most frequent languages. Texts are drawn by their hash, equal ones once; tasks keep the least hashes of each language, and of these Spark keeps the least, before the driver gets
any. Documents of languages beyond `max_languages` are predicted, as one of those. Backpropagation through time over windows, with Adam; every position is labelled with its
document's language. The sample's order and all random numbers come from fixed seeds and content hashes.

Prediction sends the weights (some kB) with the task and needs no shuffle. Nulls: a text that is null or has no letter gets `und` and a score of
0, as do all if there is nothing to learn from; a null lang is never learnt from; a null doc_id counts as an empty text for the fold. Repeated rows
are each returned. Ties go to the first language by name. Very long texts are many windows, worked on by slices of 16 MB. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lowered, slices, split_of, table

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: How far a unit's state may be from that of a run over the whole text where a window begins.
CLOSE = 0.25
#: Probabilities are worked out for so many positions times languages at a time.
Z_VALUES = 1 << 18
#: Texts are scored by so many bytes: enough for full columns, and for what is run again to run together.
SLICE = 16 << 20


@dataclass(frozen=True)
class Settings:
    hidden: int = 12
    window: int = 1024
    context: int = 128
    train_window: int = 64
    per_language: int = 6000
    windows_per_document: int = 4
    sample: int = 400_000
    max_languages: int = 256
    steps: int = 500
    batch: int = 256
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Layer:
    """One direction: gate inputs by byte (256 x 3H: update, reset, candidate) and recurrent weights (H x 3H)."""

    def __init__(self, table: np.ndarray, recurrent: np.ndarray):
        self.table, self.recurrent = table, recurrent

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States after each step for bytes x (time by column); mask is 0 behind a column's end. keep: also what backward needs."""
        steps, n = x.shape
        hidden = self.recurrent.shape[0]
        state = np.zeros((n, hidden), np.float32)
        states = np.empty((steps, n, hidden), np.float32)
        held = []
        for t in range(steps):
            a = self.table[x[t]]
            r = state @ self.recurrent
            gates = _sigmoid(a[:, : 2 * hidden] + r[:, : 2 * hidden])
            update, reset = gates[:, :hidden], gates[:, hidden:]
            candidate = np.tanh(a[:, 2 * hidden :] + reset * r[:, 2 * hidden :])
            before = state
            state = candidate + update * (state - candidate)
            if mask is not None:
                state *= mask[t, :, None]
            states[t] = state
            if keep:
                held.append((before, gates, candidate, r[:, 2 * hidden :]))
        return (states, held) if keep else states

    def backward(self, x: np.ndarray, mask: np.ndarray, held: list, toward: np.ndarray):
        """Gradients of table and recurrent, from those of the states."""
        hidden = self.recurrent.shape[0]
        table, recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        flow, pushed = np.zeros_like(toward[0]), np.empty((*x.shape, table.shape[1]), table.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, gates, candidate, inner = held[t]
            update, reset = gates[:, :hidden], gates[:, hidden:]
            d = (flow + toward[t]) * mask[t, :, None]
            d_candidate = d * (1 - update) * (1 - candidate**2)
            d_update = d * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_r = np.concatenate([d_update, d_reset, d_candidate * reset], 1)
            recurrent += before.T @ d_r
            pushed[t] = np.concatenate([d_update, d_reset, d_candidate], 1)
            flow = d * update + d_r @ self.recurrent.T
        order = np.argsort(x, None, kind="stable")
        letters, first = np.unique(x.ravel()[order], return_index=True)
        table[letters] = np.add.reduceat(pushed.reshape(-1, table.shape[1])[order], first)
        return table, recurrent

    def states(self, x: np.ndarray, inside: np.ndarray, skip: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (time, column, unit) for bytes x (time by column) from time skip on, quicker than forward: each gate lies by itself; and those before that. inside: False beyond a text,
        where states are 0. At each time only the first columns run, as far as those that have begun and haven't ended: columns with longer texts should come first."""
        steps, n = x.shape
        hidden = self.recurrent.shape[0]
        rows, weights = (np.array(w.reshape(-1, 3, hidden).swapaxes(0, 1), np.float32, order="C") for w in (self.table, self.recurrent))
        for w in (rows, weights):  # as exp takes them in 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2x)) - 1
            w[:2] *= -1
            w[2] *= -2
        reach = np.where(inside.any(1), n - inside[:, ::-1].argmax(1), 0)
        live = np.minimum(np.maximum.accumulate(reach), np.maximum.accumulate(reach[::-1])[::-1]).tolist()
        out = np.zeros((steps - skip, n, hidden), np.float32)
        all_states = np.zeros((n, hidden), np.float32) if start is None else np.array(start, np.float32)
        begin, whole, m, room = all_states.copy(), inside.all(1), -1, np.empty((2, 3 * n * hidden), np.float32)
        np.seterr(over="ignore")
        for t in range(steps):
            if live[t] != m:
                if live[t] < m:
                    all_states[live[t] :] = 0
                m = live[t]
                a, r = (b[: 3 * m * hidden].reshape(3, m, hidden) for b in room)
                gates, (update, reset, candidate), inner, state = a[:2], a, r[2], all_states[:m]
            np.take(rows, x[t, :m], axis=1, out=a, mode="clip")
            np.matmul(state, weights, out=r)
            gates += r[:2]
            np.exp(gates, out=gates)  # to infinity where it must, whose reciprocal is 0
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(reset, inner, out=inner)
            candidate += inner
            np.exp(candidate, out=candidate)
            candidate += 1
            np.divide(2, candidate, out=candidate)
            candidate -= 1
            state -= candidate
            state *= update
            state += candidate
            if not whole[t]:
                state *= inside[t, :m, None]
            if t >= skip:
                out[t - skip, :m] = state
            elif t == skip - 1:
                begin = all_states.copy()
        return out, begin


@dataclass
class Model:
    languages: list[str]
    ahead: Layer
    back: Layer
    out: np.ndarray
    bias: np.ndarray

    def logits(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        hidden = ahead.shape[-1]
        return ahead @ self.out[:hidden] + back @ self.out[hidden:] + self.bias

    def probabilities(self, x: np.ndarray, inside: np.ndarray, own: np.ndarray, context: int, start: tuple | None = None) -> tuple:
        """Of each language, summed over the positions of each column (a row a column); and of both directions the states (a row a column) before a column's first position and
        after its last. x: bytes (time by column) with `context` of them before and behind; inside, own: which belong to the text, and to the column; start: states to begin with."""
        steps, n, k = len(x) - context, x.shape[1], len(self.bias)
        ahead, into = self.ahead.states(x[:steps], inside[:steps], context, start and start[0])
        back, from_behind = self.back.states(x[: context - 1 if context else None : -1], inside[: context - 1 if context else None : -1], context, start and start[1])
        hidden, total, some = ahead.shape[2], np.zeros((k, n)), max(1, Z_VALUES // max(1, n * k))
        for at in range(0, steps - context, some):
            end = min(at + some, steps - context)
            z = self.out[:hidden].T @ ahead[at:end].reshape(-1, hidden).T
            z += self.out[hidden:].T @ back[::-1][at:end].reshape(-1, hidden).T
            z += self.bias[:, None]
            z -= z.max(0)
            np.exp(z, out=z)
            z *= own[context + at : context + end].ravel() / z.sum(0)
            total += z.reshape(k, end - at, n).sum(1)
        return total.T, (into, ahead[-1]), (from_behind, back[-1])


def train(samples: list[tuple[bytes, int]], languages: list[str], own: Settings) -> Model:
    """samples: windows of at most train_window bytes with the number of their language."""
    rng = np.random.default_rng(own.seed)
    h, n = own.hidden, len(languages)
    value = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    model = Model(languages, *(Layer(value(256, 3 * h, by=0.3), value(h, 3 * h, by=0.5 / h**0.5)) for _ in range(2)), value(2 * h, n, by=0.3), np.zeros(n, np.float32))
    x = np.zeros((own.train_window, len(samples)), np.uint8)
    mask = np.zeros(x.shape, np.float32)
    for k, (text, _) in enumerate(samples):
        x[: len(text), k] = np.frombuffer(text, np.uint8)
        mask[: len(text), k] = 1
    label = np.array([k for _, k in samples])
    by_label = [np.flatnonzero(label == k) for k in range(n)]
    parts = [model.ahead.table, model.ahead.recurrent, model.back.table, model.back.recurrent, model.out, model.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, own.steps + 1):
        pick = np.array([rng.choice(by_label[k]) for k in rng.integers(0, n, own.batch)])  # languages alike often
        bx, bm, y = x[:, pick], mask[:, pick], label[pick]
        ahead, held = model.ahead.forward(bx, bm, keep=True)
        back, back_held = model.back.forward(bx[::-1], bm[::-1], keep=True)
        z = model.logits(ahead, back[::-1])
        z = np.exp(z - z.max(-1, keepdims=True))
        z /= z.sum(-1, keepdims=True)
        z[:, np.arange(len(y)), y] -= 1
        z *= bm[..., None] / bm.sum()
        flat = z.reshape(-1, n)
        both = np.concatenate([ahead, back[::-1]], -1).reshape(-1, 2 * h)
        to = z @ model.out.T
        found = [*model.ahead.backward(bx, bm, held, to[..., :h]), *model.back.backward(bx[::-1], bm[::-1], back_held, to[::-1, :, h:]), both.T @ flat, flat.sum(0)]
        scale = min(1.0, 1.0 / (sum(float((g**2).sum()) for g in found) ** 0.5 + 1e-9))
        rate = own.rate * (1 - step / (own.steps + 1))
        for p, g, m, v in zip(parts, found, first, second, strict=True):
            g *= scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _cut(n: int, size: int, seed: int, most: int) -> list[int]:
    """Where windows of a training text begin: all over the text, placed by its hash."""
    if n <= size:
        return [0] if n else []
    rng = np.random.default_rng(seed)
    return sorted(set(rng.integers(0, n - size + 1, min(most, -(-n // size))).tolist()))


def sample(docs: DataFrame, own: Settings) -> tuple[list[tuple[bytes, int]], list[str]]:
    """Windows for training with the numbers of their languages, and the languages by name. docs: text, lang."""
    docs = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    counts = docs.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct(key).alias("texts")).orderBy(F.desc("count"), "lang").limit(own.max_languages).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], []
    most = min(own.per_language, own.sample // len(languages))  # windows of a language
    texts = -(-2 * most // own.windows_per_document)  # and texts that they come from, more than enough
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, texts / max(1, r["texts"])))))
    picked = docs.withColumn("key", key).where(F.pmod("key", F.lit(1 << 24)) < F.element_at(share, F.col("lang")) * (1 << 24))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, list]] = {}
        for batch in batches:
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                own_texts = kept.setdefault(lang, {})
                if key in own_texts:
                    continue
                data = text.as_buffer().to_pybytes()
                own_texts[key] = [(lang, key, at, data[at : at + own.train_window]) for at in _cut(len(data), own.train_window, key & (1 << 63) - 1, own.windows_per_document)]
                if len(own_texts) > 2 * texts:
                    kept[lang] = {k: own_texts[k] for k in sorted(own_texts)[:texts]}
        rows = [row for own_texts in kept.values() for k in sorted(own_texts)[:texts] for row in own_texts[k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "key", "at", "text"])

    rows = picked.select("lang", "key", "text").mapInArrow(windows, "lang string, key long, at long, text binary").dropDuplicates(["lang", "key", "at"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "at"))).where(F.col("place") <= most)
    number = {lang: k for k, lang in enumerate(languages)}
    found = [(number[r["lang"]], r["place"], bytes(r["text"])) for r in rows.select("lang", "place", "text").collect()]
    return [(lowered(np.frombuffer(t, np.uint8)).tobytes(), k) for k, _, t in sorted(found)], languages


def fit(docs: DataFrame, own: Settings | None = None) -> Model | None:
    """A model of the languages of docs' text and lang; None if there are none."""
    own = own or Settings()
    samples, languages = sample(docs, own)
    return train(samples, languages, own) if samples else None


def scores(model: Model, column: pa.Array, window: int, context: int, columns: int = 1024) -> np.ndarray:
    """Mean probabilities of each text's positions; rows of 0 for empty texts."""
    out = np.zeros((len(column), len(model.languages)))
    hidden = model.ahead.recurrent.shape[0]
    for row, data, offsets in slices(column, SLICE):
        data = lowered(data)
        size = np.diff(offsets)
        n = -(-size // window)
        owner = np.repeat(np.arange(len(size)), n)
        begin = np.repeat(offsets[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
        length = np.minimum(window, offsets[1:][owner] - begin)
        found = np.zeros((len(owner), len(model.languages)))
        edges = np.zeros((2, 2, len(owner), hidden), np.float32)  # ahead, back: states before the first position, after the last

        def run(k: np.ndarray, context: int, start: tuple | None = None) -> None:
            steps = np.arange(-context, int(length[k].max()) + context, dtype=np.int64)[:, None]
            place = begin[k] + steps
            inside = (place >= offsets[:-1][owner[k]]) & (place < offsets[1:][owner[k]])
            own = inside & (steps >= 0) & (steps < length[k])
            if start is not None:
                inside &= own  # what stands before and behind is in the states
            x = data[np.clip(place, 0, max(0, len(data) - 1))]
            found[k], *ends = model.probabilities(x, inside, own, context, start)
            for d, (first, last) in enumerate(ends):
                edges[d, 0, k], edges[d, 1, k] = first, last

        order = np.argsort(-np.minimum(offsets[1:][owner] - begin, window + context), kind="stable")  # longer columns first, as they run
        for at in range(0, len(order), columns):
            run(order[at : at + columns], context)
        inner = np.flatnonzero(owner[1:] == owner[:-1])  # windows with one behind them
        while len(inner):
            off = [np.abs(edges[0, 0, inner + 1] - edges[0, 1, inner]).max(1) > CLOSE, np.abs(edges[1, 0, inner] - edges[1, 1, inner + 1]).max(1) > CLOSE]
            again = np.unique(np.concatenate((inner[off[0]] + 1, inner[off[1]])))
            if not len(again):
                break
            behind = np.zeros(len(owner), bool)
            behind[inner + 1] = True
            before = np.zeros(len(owner), bool)
            before[inner] = True
            start = (np.where(behind[again, None], edges[0, 1, again - 1], 0), np.where(before[again, None], edges[1, 1, np.minimum(again + 1, len(owner) - 1)], 0))
            longer = np.argsort(-length[again], kind="stable")  # all lengths together: a column shorter than others ends its text, and its way back begins there from 0
            for at in range(0, len(longer), columns):
                part = longer[at : at + columns]
                run(again[part], 0, (start[0][part], start[1][part]))
        np.add.at(out, row + owner, found)
        out[row : row + len(size)] /= np.maximum(size, 1)[:, None]
    return out


def predict(docs: DataFrame, model: Model | None, window: int = Settings.window, context: int = Settings.context) -> DataFrame:
    """docs with lang_pred and score added (in the place of such columns)."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            if own is None:
                names, best = pa.array([UNKNOWN] * len(text)), np.zeros(len(text))
            else:
                p = scores(own, text, window, context)
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names = pa.array(np.where(letters, np.array(own.languages, object)[p.argmax(1)], UNKNOWN), pa.string())
                best = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(best, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(labelled, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out = split_of("doc_id", FOLDS) == HELD_OUT
    model = fit(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
