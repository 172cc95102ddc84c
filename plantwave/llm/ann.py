"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector less the mean of all, r, is padded with zeros to D bits' worth of coordinates, turned by a random orthogonal
matrix P and kept as the signs of P r (packed bits), its length |r| and the correction <sign(P r) / sqrt(D), P r / |r|>. A
query is turned likewise, quantised to a few bits a coordinate and cut into bit planes; its product with the signs is
then counts of common bits (the rounding adds its own error). <q, v> is estimated as <q, mean> + |r| <P q, signs> / (sqrt(D) correction), within
|q| |r| sqrt((1 - correction^2) / correction^2) eps / sqrt(D - 1). The codes need no training; the mean is taken over all rows.

The encoded vectors are written once, and all of them are scanned for each part of the queries, at most about QUERY_BYTES of vectors,
which alone goes to the tasks. A task carries the k-th best exact product of each query from batch to batch, and
only vectors whose upper bound reaches it are reranked by the exact product in double precision. A window joins the
k best of the tasks; nothing else is shuffled.

Defined cases: vectors that are null, zero, of another dimension than most, or holding null or non-finite
components take no part, nor do rows without an id; a query's own row is no candidate for it, other rows of its id
are; each query row has neighbours of its own, so repeated ids have as many lists; equal scores go by smaller id; fewer
candidates than k are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Least bits of a code, bits of a query's coordinate, standard errors of the bounds, bytes of queries' vectors sent to the tasks at once.
CODE_BITS, QUERY_BITS, EPS, QUERY_BYTES = 256, 3, 1.3, 8 << 20
_DATA = "row long, vec_id long, asked boolean, v array<double>, code binary, length double, correction double"


def code_bits(dim: int) -> int:
    return max(CODE_BITS, -(-dim // 64) * 64)


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix of `bits` rows, as far as it meets vectors padded with zeros: (bits, dim)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs as 64-bit words, lengths, corrections) of the vectors less the mean."""
    rest = vectors - mean
    length = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn.T
    correction = np.abs(turned).sum(1) / np.sqrt(len(turn)) / np.where(length > 0, length, 1)
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), length, np.where(length > 0, correction, 1.0)


class Query:
    """A turned query as bit planes, and its k best so far: scores falling, ties by id."""

    def __init__(self, row: int, id_: int, vector: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> None:
        self.row, self.id, self.vector = row, id_, vector
        turned = turn @ vector
        self.low = float(turned.min())
        self.step = (float(turned.max()) - self.low) / (2**QUERY_BITS - 1) or 1.0
        levels = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.planes = np.packbits(levels >> np.arange(QUERY_BITS, dtype=np.uint8)[:, None] & 1, axis=1, bitorder="little").view(np.uint64)
        self.total, self.base = float(self.low * len(turn) + self.step * float(levels.sum())), float(vector @ mean)
        self.norm = float(np.sqrt(vector @ vector))
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def common(self, words: np.ndarray, out: np.ndarray, counts: np.ndarray, weighed: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sum over the planes of 2^plane times the bits that plane and code have in common; words: (64-bit words, vectors)."""
        sums[:] = 0
        for b, plane in enumerate(self.planes):
            for word, own in zip(words, plane, strict=True):
                np.bitwise_count(np.bitwise_and(word, own, out=out), out=counts)
                sums += np.left_shift(counts, b, out=weighed, dtype=np.uint16)
        return sums

    def merge(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[:k]
        self.scores, self.ids = scores[best], ids[best]

    def floor(self, k: int) -> float:
        """What a vector must reach to be among the k best."""
        return float(self.scores[-1]) if len(self.scores) == k else -np.inf


class Batch:
    """Encoded vectors that queries are compared with."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, correction: np.ndarray, eps: float) -> None:
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.words = np.ascontiguousarray(codes.T)
        bits = 64 * len(self.words)
        self.ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        scale = length / (np.sqrt(bits) * correction)
        spread = length * np.sqrt(np.maximum(1 - correction**2, 0)) / correction * eps / np.sqrt(bits - 1)
        self.scale, self.spread, self.rounding = (x.astype(np.float32) for x in (scale, spread**2, (scale * eps) ** 2 * bits / 12))
        n = len(ids)
        self.room = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint16), np.empty(n, np.uint16)

    def search(self, q: Query, k: int) -> int:
        """Merges the batch's best into the query's; returns how many vectors were reranked."""
        product = q.common(self.words, *self.room) * np.float32(2 * q.step)
        product += self.ones * np.float32(2 * q.low) - np.float32(q.total)
        high = product * self.scale
        error = self.spread * np.float32(q.norm**2) + self.rounding * np.float32(q.step**2)
        high += np.sqrt(error, out=error)
        high += np.float32(q.base + 1e-5 * (1 + abs(q.base)))
        own = np.flatnonzero(self.rows == q.row)
        high[own] = -np.inf
        seen = 0
        if len(q.scores) < k:  # no bound yet: the most promising ones give it
            first = np.argpartition(high, -k)[-k:] if len(high) > k else np.arange(len(high))
            first = first[high[first] > -np.inf]
            self._rerank(q, first, k)
            high[first] = -np.inf
            seen = len(first)
        near = np.flatnonzero((high >= q.floor(k)) & (high > -np.inf))
        if len(near):
            self._rerank(q, near, k)
        return seen + len(near)

    def _rerank(self, q: Query, near: np.ndarray, k: int) -> None:
        q.merge((self.vectors[near] * q.vector).sum(1), self.ids[near], k)  # by rows, so that equal vectors score alike


def valid(vectors: DataFrame, id_col: str, vec_col: str, asked: Column) -> DataFrame:
    """(vec_id, v array<double>, asked) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    known = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    return known.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(sound)


def encoded(base: DataFrame, dim: int, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """base with codes, written; row numbers tell equal rows apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, length, correction = encode(_matrix(batch.column(3), dim), mean, turn)
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(correction)], ["row", "vec_id", "asked", "v", "code", "length", "correction"])

    return materialize(base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "asked", "v").mapInArrow(run, _DATA), "vectors")


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", eps: float = EPS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors where `asked` holds, its k nearest by inner product."""
    found, _ = search(vectors, asked, k, id_col, vec_col, eps)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asked: Column, k: int, id_col: str, vec_col: str, eps: float) -> tuple[DataFrame, DataFrame]:
    """(the k best of each task and query, how many vectors each task compared and reranked)."""
    base = valid(vectors, id_col, vec_col, asked)
    size = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = size["dim"] if size else 1
    base = base.where(F.size("v") == dim)
    mean, turn = _mean(base, dim), rotation(dim, code_bits(dim))
    data = encoded(base, dim, mean, turn)
    ask = data.where("asked").select("row", "vec_id", "v")
    parts = -(-max(ask.count(), 1) * max(dim, 1) * 8 // QUERY_BYTES)
    out = []
    for part in range(parts):
        chosen = ask.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).toArrow()  # about QUERY_BYTES
        out.append(materialize(_scan(data, chosen, dim, mean, turn, k, eps), "nearest"))
    discard(data)
    both = functools.reduce(DataFrame.unionAll, out)
    return both.where("score is not null").drop("compared", "reranked"), both.where("score is null").select("compared", "reranked")


def _scan(data: DataFrame, chosen: pa.Table, dim: int, mean: np.ndarray, turn: np.ndarray, k: int, eps: float) -> DataFrame:
    asked = data.sparkSession.sparkContext.broadcast((chosen["row"].to_numpy(), chosen["vec_id"].to_numpy(), _matrix(chosen["v"].combine_chunks(), dim)))
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64()), ("reranked", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[Query] = []
        compared = reranked = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = queries or [Query(r, i, v, mean, turn) for r, i, v in zip(*asked.value, strict=True)]
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            part = Batch(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim), codes, batch.column(4).to_numpy(), batch.column(5).to_numpy(), eps)
            reranked += sum(part.search(q, k) for q in queries)
            compared += len(queries) * batch.num_rows
        for at in range(0, len(queries), 1000):
            some = queries[at : at + 1000]
            sizes = [len(q.ids) for q in some]
            cols = [np.repeat([q.row for q in some], sizes), np.repeat([q.id for q in some], sizes), np.concatenate([q.ids for q in some]), np.concatenate([q.scores for q in some])]
            empty = pa.nulls(sum(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)] + [empty, empty], schema=schema)
        if queries:
            yield pa.RecordBatch.from_pylist([{"compared": compared, "reranked": reranked}], schema=schema)

    ddl = "query_row long, query_id long, vec_id long, score double, compared long, reranked long"
    return data.select("row", "vec_id", "v", "code", "length", "correction").mapInArrow(run, ddl)


def _mean(base: DataFrame, dim: int) -> np.ndarray:
    """The mean vector: partial sums in the tasks, one row a dimension at the driver."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += _matrix(batch.column(0), dim).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total, pa.float64()), pa.array(np.full(dim, n), pa.int64())], ["d", "s", "n"])

    rows = base.select("v").mapInArrow(sums, "d int, s double, n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    mean = np.zeros(dim)
    for r in rows:
        mean[r["d"]] = r["s"] / max(r["n"], 1)
    return mean


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
