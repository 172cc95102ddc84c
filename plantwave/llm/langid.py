"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent units read a window of bytes forwards and backwards; a softmax on both states labels every
position, and the mean of the labels at letters over the whole text gives the document's probabilities. Training is
backpropagation through time with Adam on windows of a bounded sample of labelled documents.

The bytes of a text are cut into windows of WINDOW bytes, which are read each for itself: no state passes from one to the
next, a character of several bytes may lie in two of them, and the last one is filled up with zero bytes, which the backward
unit reads first.

Defined cases: a null text and one without a letter are `und` with score 0; without any labelled document
everything is `und`; rows are judged one by one, repeated ones alike; a null id is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, windows read at once.
WINDOW, ROWS = 128, 1024
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Unit:
    """One direction: input rows by byte (update, reset, candidate gate), recurrent weights."""

    table: np.ndarray
    weights: np.ndarray

    def read(self, text: np.ndarray) -> np.ndarray:
        """States (time, rows, hidden) of bytes (time, rows)."""
        hidden = self.weights.shape[0]
        gate_rows, new_rows = np.ascontiguousarray(-self.table[:, : 2 * hidden]), np.ascontiguousarray(self.table[:, 2 * hidden :])
        gate_weights, new_weights = np.ascontiguousarray(-self.weights[:, : 2 * hidden]), np.ascontiguousarray(self.weights[:, 2 * hidden :])
        rows = text.shape[1]
        gates, sums = np.empty((2, rows, 2 * hidden), np.float32)
        new, rest = np.empty((2, rows, hidden), np.float32)
        state = np.zeros((rows, hidden), np.float32)
        states = np.empty((*text.shape, hidden), np.float32)
        for t, row in enumerate(text):  # in place: this loop is the cost of the operator
            np.take(gate_rows, row, axis=0, out=gates, mode="clip")
            gates += np.matmul(state, gate_weights, out=sums)
            np.exp(np.minimum(gates, 80, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.take(new_rows, row, axis=0, out=new, mode="clip")
            np.matmul(state, new_weights, out=rest)
            rest *= gates[:, hidden:]
            new += rest
            np.tanh(new, out=new)
            np.subtract(state, new, out=rest)
            rest *= gates[:, :hidden]
            state = np.add(new, rest, out=states[t])
        return states

    def learn(self, text: np.ndarray, states: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and weights, by time backwards; slope: the loss's by each state."""
        hidden = self.weights.shape[0]
        weights, inputs = np.zeros_like(self.weights), np.empty((*text.shape, 3 * hidden), np.float32)
        carried = np.zeros(states.shape[1:], np.float32)
        for t in range(len(text) - 1, -1, -1):
            before = states[t - 1] if t else np.zeros_like(states[0])
            x, a = self.table[text[t]], before @ self.weights
            gates = sigmoid(x[:, : 2 * hidden] + a[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(x[:, 2 * hidden :] + r * a[:, 2 * hidden :])
            d = slope[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([d * (before - new) * z * (1 - z), d_new * a[:, 2 * hidden :] * r * (1 - r)], 1)
            d_a = np.concatenate([d_gates, d_new * r], 1)
            inputs[t] = np.concatenate([d_gates, d_new], 1)
            weights += before.T @ d_a
            carried = d * z + d_a @ self.weights.T
        table = np.zeros_like(self.table)
        np.add.at(table, text.ravel(), inputs.reshape(-1, 3 * hidden))
        return table, weights


@dataclass
class Model:
    languages: list[str]
    forward: Unit
    backward: Unit
    out: np.ndarray  # (2 hidden + 1, languages)

    def parts(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.weights, self.backward.table, self.backward.weights, self.out]

    def label(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states forwards, states backwards, probabilities by language) at each position of bytes (time, rows)."""
        text = text.astype(np.intp)
        a, b = self.forward.read(text), self.backward.read(text[::-1])[::-1]
        hidden = a.shape[2]
        p = self.out[:hidden].T @ a.reshape(-1, hidden).T + self.out[-1][:, None]
        p += self.out[hidden:-1].T @ np.ascontiguousarray(b).reshape(-1, hidden).T
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return a, b, p.reshape(-1, *text.shape)

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of whole texts."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        group: list[tuple[int, bytes]] = []
        rows = 0
        for i, text in enumerate(texts):
            if not text or not self.languages or not any(map(str.isalpha, text)):
                continue
            raw = text.encode()
            for at in range(0, len(raw), WINDOW * ROWS):  # of very long texts, parts
                group.append((i, raw[at : at + WINDOW * ROWS]))
                rows += -(-len(group[-1][1]) // WINDOW)
                if rows >= ROWS:
                    self._pool(group, out)
                    group, rows = [], 0
        self._pool(group, out)
        return [(self.languages[int(np.argmax(s))], float(np.max(s) / s.sum())) if isinstance(s, np.ndarray) else s for s in out]

    def _pool(self, group: list[tuple[int, bytes]], out: list) -> None:
        """Adds the labels at letters of each text's part to its sums; out holds arrays of sums meanwhile."""
        if not group:
            return
        sizes = [-(-len(raw) // WINDOW) for _, raw in group]
        data = np.zeros((sum(sizes), WINDOW), np.uint8)
        flat, at = data.reshape(-1), 0
        for (_, raw), n in zip(group, sizes, strict=True):
            flat[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
            at += n * WINDOW
        text = np.ascontiguousarray(data.T)
        *_, p = self.label(text)
        sums = (p * _LETTER[text]).sum(1).T
        starts = np.cumsum([0, *sizes[:-1]])
        for (i, _), s in zip(group, np.add.reduceat(sums, starts, 0).astype(float), strict=True):
            out[i] = (out[i] if isinstance(out[i], np.ndarray) else 1e-9) + s


def train(windows: list[tuple[str, bytes]], hidden: int = 16, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Model:
    """A model of (language, bytes) windows of at most WINDOW bytes; batches hold all languages alike."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in windows})
    unit = lambda: Unit(rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32), rng.normal(0, 0.25, (hidden, 3 * hidden)).astype(np.float32))
    model = Model(languages, unit(), unit(), rng.normal(0, 0.1, (2 * hidden + 1, len(languages))).astype(np.float32))
    if len(languages) < 1:
        return model
    by = [[w for lang, w in windows if lang == name] for name in languages]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    for step in range(steps):
        goal = rng.integers(0, len(languages), batch)
        text = np.zeros((WINDOW, batch), np.uint8)
        for j, g in enumerate(goal):
            raw = by[g][rng.integers(len(by[g]))]
            text[: len(raw), j] = np.frombuffer(raw, np.uint8)
        a, b, p = model.label(text)
        both = np.concatenate([a, b, np.ones((*text.shape, 1), np.float32)], 2)
        slope = np.ascontiguousarray(p.transpose(1, 2, 0))
        slope[:, np.arange(batch), goal] -= 1
        slope *= (_LETTER[text] / max(1, _LETTER[text].sum()))[:, :, None]
        back = slope @ model.out.T
        grads = [
            *model.forward.learn(text, both[:, :, :hidden], back[:, :, :hidden]),
            *model.backward.learn(text[::-1], both[::-1, :, hidden : 2 * hidden], back[::-1, :, hidden : 2 * hidden]),
            np.einsum("tbi,tbj->ij", both, slope, optimize=True),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * (1 - step / steps) + 1e-4
        for part, grad, (m, v) in zip(model.parts(), grads, moment, strict=True):
            grad = grad / max(1.0, norm)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            part -= pace * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_windows(docs: DataFrame, per_language: int) -> list[tuple[str, bytes]]:
    """About per_language documents of each language, chosen by the hash of their text; a window of each, at a place by the hash."""
    known = docs.where("lang is not null and text is not null and text <> ''")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return []
    chance = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(1_000_000 * per_language / r["n"]) + 1))))
    h = F.xxhash64("text")
    place = F.pmod(h, F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    rows = known.where(F.pmod(F.shiftright(h, 20), F.lit(1_000_000)) < chance[F.col("lang")]).select("lang", F.substring("text", place, F.lit(WINDOW)).alias("w")).distinct().orderBy("lang", "w").collect()
    return [(r["lang"], r["w"].encode()[:WINDOW]) for r in rows]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few ten thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.documents(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, per_language: int = 1500) -> Model:
    """A model of docs (doc_id, text, lang) outside the held-out fold; the sample has about per_language rows a language."""
    return train(training_windows(docs.where(~held_out(F.col("doc_id"))), per_language))


def keep_languages(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs whose text has a language of at least this score; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != "und" and score >= least_score for lang, score in shared.value.documents(texts.tolist())], dtype=bool)

    return docs.where(known(F.col("text")))
