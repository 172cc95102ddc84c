"""Quality rules with line labelling by a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated 8-word windows of the whole text. Then every line with a
word gets features; Viterbi decoding labels the sequence of lines as content or boilerplate, and the share of words in
content lines decides whether the document stays. The field is fitted by forward-backward gradients on a bounded
sample of labelled documents. Only documents bear labels, so the lines' labels are latent: they begin as the document's,
then each round fits a field and decodes the lines anew, under the constraint that content keeps its share of the words
of good documents and stays below it in bad ones. So lines of prose among junk, and of junk among prose, teach the field to
switch within a document.

Defined cases: a null or wordless text has counts of zero and fails the base rules; without labelled documents the
base rules alone decide; rows are judged one by one, repeated ones alike; a null id is kept; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import SPACE, line_hashes, mix, slabs, word_spans

#: Words to a repeated window; words that a document needs; percent of words that may lie in repeated windows.
REPEAT, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Share of words in content lines from which a document stays; lines of a training sequence.
CONTENT_SHARE, SEQUENCE = 0.5, 64
_SYMBOL, _UPPER, _DIGIT, _END = (np.zeros(256, np.int32) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_END[list(b".!?")] = 1
FEATURES = ("bias", "log words", "upper", "symbols", "bars", "exclaimed", "digits", "word length", "line repeated", "word repeated", "window repeated", "no full stop", "short", "first", "last")


@dataclass
class Field:
    """Weights of the features for content against boilerplate, and scores of label pairs (from, to)."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label (1: content) of each line of one text."""
        scores = (features @ self.weights).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_a, from_b = a + p00 >= b + p10, a + p01 >= b + p11
            a, b = (a + p00 if from_a else b + p10), (a + p01 if from_b else b + p11) + s
            back.append((from_a, from_b))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = 0 if step[label] else 1
            out.append(label)
        return np.array(out[::-1])


def measure(column: pa.Array) -> Iterator[tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]]:
    """For each text ((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), words by line, features by line)."""
    for _, data, starts in slabs(column):
        n = len(starts)
        if not len(data):
            yield from (((0, 0, 0, 0, 0), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)), np.float32)) for _ in range(n))
            continue
        a, b, hashes = word_spans(data, starts)
        text_of = np.searchsorted(starts, a, "right") - 1
        repeated = _repeated_windows(hashes, text_of)
        again = np.zeros(len(a), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        newline = np.flatnonzero(data == 10) + 1
        line_start = np.union1d(np.unique(starts[starts < len(data)]), newline[newline < len(data)])
        line_end = np.append(line_start[1:], len(data))
        ends_newline = data[line_end - 1] == 10
        line_text = np.searchsorted(starts, line_start, "right") - 1
        first_word = np.append(np.searchsorted(a, line_start), len(a))
        words = np.diff(first_word)
        full = words > 0
        line_start, line_end, line_text, words = line_start[full], line_end[full] - ends_newline[full], line_text[full], words[full]
        at = first_word[:-1][full]
        line_hash = mix(line_hashes(data, line_start, line_end) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, earliest = np.unique(line_hash, return_index=True)
        dup = np.ones(len(line_hash), bool)
        dup[earliest] = False

        def per_line(flags: np.ndarray, starts_=line_start, ends_=line_end) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return sums[ends_] - sums[starts_]

        def per_word(flags: np.ndarray, at_=at, words_=words) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return sums[at_ + words_] - sums[at_]

        points = ((data & 0xC0) != 0x80) & ~SPACE[data]
        upper = _UPPER[data]
        upper[1:] += (data[:-1] == 0xC3) & (data[1:] < 0x9F)  # capitals with accents
        symbols = _SYMBOL[data]
        chars = np.maximum(per_line(points), 1)
        stop = _END[data[b[at + words - 1] - 1]]
        newest = np.ones(len(words), bool)
        newest[1:] = line_text[1:] != line_text[:-1]
        features = np.stack(
            [
                np.ones(len(words)),
                np.log1p(words) / 5,
                per_line(upper) / chars,
                np.minimum(per_line(symbols) / words, 1),
                np.minimum(per_line(data == 124) / words, 1),
                np.minimum(per_line(data == 33) / words, 1),
                per_line(_DIGIT[data]) / chars,
                np.minimum(chars / words / 10, 2),
                dup,
                per_word(again) / words,
                per_word(repeated) / words,
                1 - stop,
                words < 4,
                newest,
                np.append(newest[1:], True) if len(newest) else newest,
            ],
            1,
        ).astype(np.float32)
        lines = np.searchsorted(line_text, np.arange(n + 1))
        count = lambda flags, of: np.bincount(of, flags, n).astype(np.int64)
        bytes_of = np.searchsorted(starts, np.arange(len(data)), "right") - 1 if n > 1 else np.zeros(len(data), np.int64)
        totals = np.stack([np.bincount(text_of, minlength=n), count(points, bytes_of), count(symbols, bytes_of), count(dup, line_text), count(repeated, text_of)], 1).tolist()
        for i, row in enumerate(totals):
            yield tuple(row), words[lines[i] : lines[i + 1]], features[lines[i] : lines[i + 1]]


def _repeated_windows(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of REPEAT words that its text has twice or more."""
    n = len(hashes) - REPEAT + 1
    if n < 2:
        return np.zeros(len(hashes), bool)
    keys = text_of[:n].astype(np.uint64)
    for i in range(REPEAT):
        keys = mix(keys + np.uint64(0x2545F4914F6CDD1D)) + hashes[i : n + i]
    inside = np.flatnonzero(text_of[:n] == text_of[REPEAT - 1 :])
    order = inside[np.argsort(keys[inside], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT, -1)
    return np.cumsum(cover[:-1]) > 0


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


JUDGED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def verdicts(column: pa.Array, field: Field | None) -> Iterator[tuple]:
    """(counts, content_share, base_failed, kept) of each text."""
    for counts, words, features in measure(column):
        failed = base_failed(counts[0], counts[4])
        share = 1.0 if len(words) else 0.0
        if field is not None and len(words):
            share = float((field.decode(features) * words).sum() / words.sum())
        yield *counts, share, failed, not failed and share >= CONTENT_SHARE


def keep_content(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that the rules keep; all columns stay as they are."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([row[-1] for row in verdicts(pa.Array.from_pandas(texts, type=pa.string()), field)], dtype=bool)

    return docs.where(kept(F.col("text")))


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, counts, content_share, base_failed, kept) of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *row) for doc_id, row in zip(batch.column(0).to_pylist(), verdicts(batch.column(1), field), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(JUDGED), JUDGED, strict=True)], schema=JUDGED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Field | None:
    """A field fitted on about per_class documents of each quality, chosen by the hash of their id; None without labels.

    The chosen labels are few and are broadcast; only features of the chosen documents reach the driver."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    chance = F.create_map(*(x for q, n in counts.items() for x in (F.lit(q), F.lit(int(1_000_000 * per_class / n) + 1))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < chance[F.col("quality")])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, f) for q, (_, _, f) in zip(batch.column(1).to_pylist(), measure(batch.column(2)), strict=True) if len(f)]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([f.tobytes() for _, f in found], pa.binary())], ["quality", "features"])

    rows = sample.mapInArrow(run, "quality int, features binary").orderBy("quality", F.md5("features")).collect()
    return train([(r["quality"], np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES))) for r in rows])


def train(texts: list[tuple[int, np.ndarray]], rounds: int = 2, steps: int = 80) -> Field | None:
    """A field for texts (quality, features by line) whose lines' labels are latent."""
    if len({q for q, _ in texts}) < 2:
        return None
    labels = [np.full(len(f), q) for q, f in texts]
    field = fit_lines(texts, labels, 4 * steps, None)
    for _ in range(rounds):
        labels = [within_share(q, f, field) for q, f in texts]
        field = fit_lines(texts, labels, steps, field)
    return field


def within_share(quality: int, features: np.ndarray, field: Field) -> np.ndarray:
    """Labels of the lines by the field; the least sure ones give way until the content share suits the document's quality."""
    label = field.decode(features)
    words = np.expm1(5 * features[:, FEATURES.index("log words")].astype(float))
    scores = features @ field.weights
    right = lambda: (label @ words >= CONTENT_SHARE * words.sum()) == bool(quality)
    for line in np.argsort(-scores if quality else scores, kind="stable"):
        if right():
            break
        label[line] = quality
    return label


def fit_lines(texts: list[tuple[int, np.ndarray]], labels: list[np.ndarray], steps: int, start: Field | None, rate: float = 0.1, decay: float = 1e-3, care: float = 8.0) -> Field:
    """Adam on the log likelihood of the lines' labels; texts weigh alike, good ones in sum `care` times the others.

    start: the field to begin with; without one, lines are judged each for itself and pairs of labels have no scores."""
    parts = [(q, f[i : i + SEQUENCE], y[i : i + SEQUENCE], 1 / len(f)) for (q, f), y in zip(texts, labels, strict=True) for i in range(0, len(f), SEQUENCE)]
    length = max(len(f) for _, f, *_ in parts)
    x, gold, there = np.zeros((length, len(parts), len(FEATURES))), np.zeros((length, len(parts)), np.int64), np.zeros((length, len(parts)), bool)
    for j, (_, f, y, _) in enumerate(parts):
        x[: len(f), j], gold[: len(f), j], there[: len(f), j] = f, y, True
    quality = np.array([q for q, *_ in parts])
    weight = np.array([w * len(f) for _, f, _, w in parts])
    for q in (0, 1):
        weight[quality == q] *= (care if q else 1.0) / (1 + care) / weight[quality == q].sum()
    weight /= there.sum(0)
    pair = 2 * gold[:-1] + gold[1:]
    truth = np.array([(((pair == p) & there[1:]) * weight).sum() for p in range(4)])
    theta = np.zeros(len(FEATURES) + 4) if start is None else np.concatenate([start.weights, start.pairs.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows, flat = x[there], (there * weight)[there]
    for step in range(steps):
        slope = np.zeros_like(theta)
        if start is None:
            slope[:-4] = ((gold[there] - 1 / (1 + np.exp(-(rows @ theta[:-4])))) * flat) @ rows
        else:
            one, two = _marginals(x @ theta[:-4], there, theta[-4:].reshape(2, 2))
            slope[:-4] = ((gold - one[:, :, 1])[there] * flat) @ rows
            slope[-4:] = truth - np.einsum("tjab,j->ab", two, weight).ravel()
        slope -= decay * theta
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        theta = theta + rate * (1 - step / steps) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-9)
    return Field(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2))


def _marginals(scores: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the labels at each line, and of label pairs between lines, by forward-backward in logarithms."""
    length, n = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], 2)
    ahead, back = np.zeros((length, n, 2)), np.zeros((length, n, 2))
    ahead[0] = emit[0]
    for t in range(1, length):
        step = np.logaddexp(ahead[t - 1, :, 0, None] + pairs[0], ahead[t - 1, :, 1, None] + pairs[1]) + emit[t]
        ahead[t] = np.where(there[t][:, None], step, ahead[t - 1])
    for t in range(length - 2, -1, -1):
        out = back[t + 1] + emit[t + 1]
        step = np.logaddexp(pairs[:, 0] + out[:, 0, None], pairs[:, 1] + out[:, 1, None])
        back[t] = np.where(there[t + 1][:, None], step, back[t + 1])
    total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    one = np.exp(ahead + back - total[:, None]) * there[:, :, None]
    two = np.exp(ahead[:-1, :, :, None] + pairs + (emit[1:] + back[1:])[:, :, None, :] - total[:, None, None]) * there[1:, :, None, None]
    return one, two
