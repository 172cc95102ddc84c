"""Hard negatives: rows of another label whose score lies in a window under that of an anchor's positive.

Scores are exact integer inner products, computed in a residue number system: components are reduced modulo a few small
primes, each prime has one float32 matrix product in which no sum leaves the 24 bits that float32 holds exactly, and
the signed score comes back from its residues by Chinese remaindering, digit by digit in mixed radix with digits on both
sides of zero. The longest vector bounds every score and says how many primes are needed.

Anchors and rows are dealt into blocks by Spark; a task has the anchors of one block and streams rows past them, tile by
tile, so what it holds does not depend on the table. For the positives, anchors meet only rows of their label. Then
each anchor carries the windows of its positives past all rows, and each window keeps its first rows of another label. Tasks
keep a bounded number of rows an anchor, which windows of Spark join.

Defined cases: rows with a null id, label or vector, a null or non-finite component, another dimension than most, or a
scaled length of 2^31 or more (whose scores a long can't hold) take no part; a row is no positive of itself, other
rows of its id are; rows that share an id go by their place in the table; each anchor row has lists of its own; a positive with
a negative score has an empty window; fewer rows than asked for are all returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Dimensions of one float32 product: DEPTH * (p / 2)^2 < 2^24 for the primes below 1024.
DEPTH = 64
#: Bytes of anchors' components in a block, anchors and rows of a tile, parts into which the rows of a block are dealt, rows that make a part of its own.
ANCHOR_BYTES, TILE, STRIPES, STRIPE_ROWS = 4 << 20, (512, 2048), 64, 1 << 13
_LEAST = np.iinfo(np.int64).min
_ROW = "row long, vec_id long, label long, v array<int>"


def moduli(bound: int) -> list[int]:
    """The fewest primes below 1024, large ones first, whose product exceeds all numbers from -bound to bound."""
    out, product, p = [], 1, 1024
    while product <= 2 * bound:
        p -= 1
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as float32 from -(p - 1) / 2 to (p - 1) / 2, in place."""
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    half = np.float32(p // 2)
    x -= (x > half) * np.float32(p)
    x += (x < -half) * np.float32(p)
    return x


class Residues:
    """The rows of an integer matrix modulo each prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]) -> None:
        self.primes = primes
        self.parts = [centred((matrix % p).astype(np.float32), p) for p in primes]

    def products(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all rows of other, as int64."""
        digits: list[np.ndarray] = []
        for p, a, b in zip(self.primes, self.parts, other.parts, strict=True):
            digit = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, a.shape[1], DEPTH):
                digit += centred(a[:, at : at + DEPTH] @ b[:, at : at + DEPTH].T, p)
            digit = centred(digit, p)
            for q, lower in zip(self.primes, digits, strict=False):  # the digits before this one, then divided by their prime
                inverse = pow(q, -1, p)
                digit = centred((digit - lower) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
            digits.append(digit)
        out = np.zeros(digits[0].shape, np.int64)
        for p, digit in zip(reversed(self.primes), reversed(digits), strict=True):
            out *= p
            out += digit.astype(np.int64)
        return out


class Anchors:
    """A block of anchors and, for each of their windows, the best rows so far: scores falling, ties by id, then by row."""

    def __init__(self, batches: list[pa.RecordBatch], keep: int, same: bool, primes: list[int]) -> None:
        table = pa.Table.from_batches(batches)
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.keep, self.same = keep, same
        self.low, self.high = (matrix(table[c].combine_chunks(), len(self.row)).T.copy() for c in ("low", "high"))
        v = matrix(table["v"].combine_chunks(), len(self.row))
        self.tiles = [(slice(i, i + TILE[0]), Residues(v[i : i + TILE[0]], primes)) for i in range(0, len(v), TILE[0])]
        shape = (*self.low.shape, keep)  # windows, anchors, kept
        self.score, self.ids, self.rows = np.full(shape, _LEAST), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.width = 128

    def meet(self, batch: pa.RecordBatch, primes: list[int]) -> None:
        """Rows come by id and row; the first few set the bounds for wider tiles."""
        row, id_, label, v = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), batch.num_rows)
        at = 0
        while at < len(row):
            cut = slice(at, at + self.width)
            at, self.width = at + self.width, min(2 * self.width, TILE[1])
            rows = Residues(v[cut], primes)
            for mine, own in self.tiles:
                score = own.products(rows)
                equal = self.label[mine, None] == label[cut]
                score[~equal if self.same else equal] = _LEAST
                score[self.row[mine, None] == row[cut]] = _LEAST
                for w in range(len(self.low)):
                    bound = np.maximum(self.low[w, mine], self.score[w, mine, -1] + 1)
                    a, b = np.nonzero((score >= bound[:, None]) & (score <= self.high[w, mine, None]) & (score > _LEAST))
                    if len(a):
                        self._merge(w, mine.start + a, score[a, b], id_[cut][b], row[cut][b])

    def _merge(self, w: int, a: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        some = np.unique(a)
        have = self.score[w, some] > _LEAST
        a = np.concatenate([np.repeat(some, have.sum(1)), a])
        score, ids, rows = (np.concatenate([kept[w, some][have], new]) for kept, new in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score, a))
        a = a[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        best = order[rank < self.keep]
        a, rank = a[rank < self.keep], rank[rank < self.keep]
        self.score[w, a, rank], self.ids[w, a, rank], self.rows[w, a, rank] = score[best], ids[best], rows[best]

    def found(self) -> pa.RecordBatch:
        w, a, k = np.nonzero(self.score > _LEAST)
        cols = (self.row[a], self.id[a], w, self.rows[w, a, k], self.ids[w, a, k], self.score[w, a, k])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["anchor_row", "anchor_id", "place", "row", "vec_id", "score"])


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def scaled(vectors: DataFrame, label: Column, asked: Column, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, label, asked, v array<int>, length2) of the rows that take part; components are floor(scale * x)."""
    v = F.col(vec_col).cast("array<double>")
    known = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"), v.alias("x"))
    known = known.where("vec_id is not null and label is not null and x is not null").where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    known = known.withColumn("v", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("double")))
    known = known.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).where(F.col("length2") < 2.0**62)
    return known.select("row", "vec_id", "label", "asked", F.col("v").cast("array<int>").alias("v"), "length2")


def best(asked: DataFrame, rows: DataFrame, group: Column, parts: int, stripes: int, keep: int, same: bool, primes: list[int]) -> DataFrame:
    """(anchor_row, anchor_id, place, row, vec_id, score): the first `keep` rows of each window (place) of each anchor,
    of the anchor's label or of others. Only anchors and rows of one group meet."""
    mine, own = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(stripes)).cast("int")
    none = F.lit(None).cast("array<long>")
    a = asked.select(group.alias("g"), mine.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(True).alias("anchor"), "row", "vec_id", "label", "v", "low", "high")
    b = rows.select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), own.alias("stripe"), F.lit(False).alias("anchor"), "row", "vec_id", "label", "v", none.alias("low"), none.alias("high"))
    both = a.unionByName(b).repartition("g", "part", "stripe").sortWithinPartitions("g", "part", "stripe", F.desc("anchor"), "vec_id", "row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                here = tuple(key[:3, x].tolist())
                if here != group:
                    if block is not None:
                        yield block.found()
                    group, waiting, block = here, [], None
                part = batch.slice(x, y - x)
                if key[3, x]:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = Anchors(waiting, keep, same, primes), []
                    block.meet(part, primes)
        if block is not None:
            yield block.found()

    found = both.mapInArrow(run, "anchor_row long, anchor_id long, place int, row long, vec_id long, score long")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, label: Column, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `asked` holds: each one's
    first `positives` rows of its label, and for each the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score (0 <= low, high <= 100)."""
    data = materialize(scaled(vectors, label, asked, scale, id_col, vec_col), "scaled")
    sizes = data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asks"), F.max("length2").alias("most"))
    size = sizes.orderBy(F.desc("n"), "dim").first()
    dim, n, asks, most = (size["dim"], size["n"], size["asks"], size["most"]) if size else (0, 0, 0, 0.0)
    primes = moduli(int(most) + int(most) // 2**50 + 1)
    rows = data.where(F.size("v") == dim)
    parts, stripes = max(1, -(-asks * max(dim, 1) * 4 // ANCHOR_BYTES)), max(1, min(STRIPES, -(-n // STRIPE_ROWS)))
    every = F.array(F.lit(_LEAST + 1)), F.array(F.lit(-(_LEAST + 1)))
    anchors = rows.where("asked").withColumns({"low": every[0], "high": every[1]})
    found = materialize(best(anchors, rows, F.col("label"), parts, stripes, positives, True, primes), "positives")
    score = F.col("score")
    least, top = F.expr(f"{low} * (score div 100) + ({low} * (score % 100) + 99) div 100"), F.expr(f"{high} * (score div 100) + {high} * (score % 100) div 100")
    some = found.where(score >= 0).withColumns({"low": least, "high": top})
    windows = some.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    windows = windows.select(F.col("anchor_row").alias("row"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    empty = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.lit(positives) - F.size(c)))
    anchors = rows.where("asked").join(windows, "row").withColumns({"low": empty(F.col("low"), 0), "high": empty(F.col("high"), -1)})
    chosen = best(anchors, rows, F.lit(0).cast("long"), parts, stripes, negatives, False, primes)
    chosen = materialize(chosen.select("anchor_row", (F.col("place") + 1).alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    discard(data)
    mine = found.select("anchor_row", "anchor_id", F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mine.join(chosen, ["anchor_row", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
