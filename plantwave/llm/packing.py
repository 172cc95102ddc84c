"""Bounded-space online best-fit packing of token sequences.

Each task holds a fixed number of open bins in a bitset keyed by free space: bit f is set while a bin with f free
tokens is open. The best fit of a piece of n tokens is the lowest set bit at or above n; when too many bins are
open, the fullest (the lowest set bit) closes first. Bins that tasks leave with room are packed again among
each other as pieces of their own, so the tasks' last bins do not stay half empty; only bin numbers and sizes move.

Defined cases: strings of the tokenizer's added tokens in a text are those tokens, as in the library; a null text is an empty one and gives one piece that holds the separator only; longer documents are
cut into full pieces after a first shorter one; repeated rows are packed each for itself; a null id is kept; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, materialize, rows_of
from .tokens import tokenizers_file

SEPARATOR = b"\0\0\0\0"
#: Bins that one task of the second round packs.
BINS_A_TASK = 50_000


class BestFit:
    """Open bins keyed by free space; place() gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n << n
        if fits:
            free = (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free > n:
            self._put(free - n, number)
            if self.count > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free

    def _put(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        same = self.bins[free]
        number = same.pop()
        self.count -= 1
        if not same:
            self.bits &= ~(1 << free)
        return number


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: full pieces after a first one that may be shorter."""
    total = len(ids) // 4
    start, number = 0, 0
    while start < total:
        end = start + ((total - start) % capacity or capacity)
        yield number, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, number = end, number + 1


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("bin_offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 512) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset, at most `capacity` tokens a sequence.

    tokenizer: path of a file of the `tokenizers` library, there on every executor."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fit, first = tokenizers_file(tokenizer), BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def packed() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                for number, start, length, crc in pieces(encoder.ids(text or "") + SEPARATOR, capacity):
                    bin_, offset = fit.place(length)
                    yield doc_id, number, start, length, crc, first + bin_, offset

        yield from batches_of(packed(), _PIECES)

    placed = docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long")
    placed = materialize(placed, "pieces")
    moved = repack(placed.groupBy("bin").agg(F.sum("length").alias("filled")).where(F.col("filled") < capacity), capacity, open_bins)
    out = placed.join(moved, "bin", "left").withColumns({"sequence_id": F.coalesce("sequence", "bin"), "offset": F.col("bin_offset") + F.coalesce("shift", F.lit(0))})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def repack(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Bins (bin, filled) packed among each other: (bin, sequence, shift), sequences numbered below zero."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, open_bins), -1 - (TaskContext.get().partitionId() << 40)
        schema = pa.schema([("bin", pa.int64()), ("sequence", pa.int64()), ("shift", pa.int64())])

        def packed() -> Iterator[tuple]:
            for bin_, filled in rows_of(batches):
                number, shift = fit.place(filled)
                yield bin_, first - number, shift

        yield from batches_of(packed(), schema)

    bins = materialize(bins, "bins")
    tasks = -(-max(1, bins.count()) // BINS_A_TASK)
    moved = materialize(bins.repartition(tasks).sortWithinPartitions(F.desc("filled"), "bin").mapInArrow(pack, "bin long, sequence long, shift long"), "moved")
    discard(bins)
    return moved
