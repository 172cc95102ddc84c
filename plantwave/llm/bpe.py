"""Byte-level BPE encoding by overlapping chunks, and decoding.

Every text is cut into chunks of `chunk` characters that overlap their neighbours. Chunks are pre-tokenised each for
itself; neighbours are stitched at the first pre-token boundary past the seam that both have found (matching runs
forward only, so from a common boundary on they agree) and that no white space stands before (it alone looks
ahead, so a piece that ends in it would be matched otherwise); the pieces between stitches are encoded and their
ids joined in order. At a seam without a common boundary, as within one huge word, the left chunk is read on until it is
in step with a later one; only that stretch stays one piece. Decoding joins the tokens' raw bytes.

The same goes on at two scales: chunks of a text are stitched where the text is read, and texts of more than
`stretch` characters are first cut into stretches that are dealt to tasks, stitched by their boundaries alone, and
encoded as texts of their own, chunk by chunk.

Defined cases: a null text is an empty one with no ids; repeated rows give repeated results (equal long texts are
encoded once); a null id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize, rows_of
from .tokens import Ranks, rank_file

#: Characters of a chunk, of an overlap on each side, and of a stretch.
CHUNK, OVERLAP, STRETCH = 2048, 128, 1 << 16


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, start: int, end: int, pattern: str) -> list[int]:
    """Starts of the pre-tokens of text[start:end] at which it may be cut, as places of the text."""
    window = text[start:end] if start or end < len(text) else text
    at = [m.start() for m in _compiled(pattern).finditer(window)]
    if end < len(text):  # the last token may go on, and its neighbour may look ahead
        at = at[:-2]
    return [start + x for x in at if x and not window[x - 1].isspace()]


def cut_points(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the stitched pieces of a text begin, and its end."""
    seams = range(0, len(text), chunk)
    read = lambda i, j: boundaries(text, max(seams[i] - overlap, 0), min(seams[j] + chunk + overlap, len(text)), pattern)
    cuts, left, found, i, stride = [0], 0, read(0, 0) if len(seams) > 1 else [], 1, 1
    while i < len(seams):
        own = read(i, i)
        common = {x for x in found if x >= seams[i]}.intersection(own)
        if common:
            cuts.append(min(common))
            left, found, i, stride = i, own, i + 1, 1
        else:  # read the left chunk on, each time twice as far
            i += stride
            stride *= 2
            if i < len(seams):
                found = read(left, i - 1)
    return [*cuts, len(text)]


def encode_text(text: str, encoder: Ranks, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """The ids of a text, piece by piece."""
    cuts = cut_points(text, encoder.pattern, chunk, overlap)
    return b"".join(encoder.ids(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, stretch: int = STRETCH) -> DataFrame:
    """docs (doc_id, text) → (doc_id, ids binary): ids as little-endian unsigned 32-bit integers."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long_ = F.length("text") > stretch

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_file(ranks, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        yield from batches_of(((d, encode_text(t, encoder, chunk, overlap)) for d, t in rows_of(batches)), schema, 500)

    short = docs.where(~long_).mapInArrow(whole, "doc_id long, ids binary")
    keyed = docs.where(long_).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    return short.unionByName(keyed.select("doc_id", "key").join(_encode_long(keyed.select("key", "text"), ranks, pattern, chunk, overlap, stretch), "key").select("doc_id", "ids"))


def stitch(stretches: list[tuple[int, list[int], list[int]]]) -> tuple[list[int], list[int], bool]:
    """(seams kept, cuts at them, whether one was dropped) of a text's stretches (seam, boundaries at its start, at its end)."""
    kept, cuts = [0], [0]
    for (_, _, before), (seam, after, _) in zip(stretches, stretches[1:], strict=False):
        if common := set(before).intersection(after):
            kept.append(seam)
            cuts.append(min(common))
    return kept, cuts, len(kept) < len(stretches)


def _encode_long(texts: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int, stretch: int) -> DataFrame:
    wide = min(8 * overlap, stretch)
    one = materialize(texts.groupBy("key").agg(F.first("text").alias("text")), "long-texts")  # copies meet before they are moved
    length = F.length("text")
    cuts = _long_cuts(one, one.select("key", F.sequence(F.lit(0), length - 1, F.lit(stretch)).alias("seams")), pattern, wide)
    spans = F.transform(F.slice("cuts", 1, F.size("cuts")), lambda a, i: F.struct(i.alias("number"), F.substring("text", a + 1, F.coalesce(F.get("cuts", i + 1), length) - a).alias("piece")))
    split = one.join(cuts, "key").select("key", F.explode(spans).alias("s")).select("key", "s.*").repartition("key", "number")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_file(ranks, pattern)
        schema = pa.schema([("key", pa.string()), ("number", pa.int32()), ("ids", pa.binary())])
        yield from batches_of(((k, n, encode_text(t, encoder, chunk, overlap)) for k, n, t in rows_of(batches)), schema, 50)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(rows_of(table.select(["number", "ids"]).to_batches()))
        return pa.table({"key": [key[0].as_py()], "ids": pa.array([b"".join(ids for _, ids in parts)], pa.binary())})

    return split.mapInArrow(encode, "key string, number int, ids binary").groupBy("key").applyInArrow(join, "key string, ids binary")


def _long_cuts(one: DataFrame, seams: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """(key, cuts) of long texts (key, text). A seam out of step is dropped, and the text's other seams are checked
    again from the stretches that are left, until none is dropped."""

    def pretokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("seam", pa.int32()), ("by_start", pa.list_(pa.int32())), ("by_end", pa.list_(pa.int32()))])

        def found() -> Iterator[tuple]:
            for key, seam, after, start, last, window in rows_of(batches):
                at = [start + x for x in boundaries(window + ("" if last else " "), 0, len(window), pattern)]
                yield key, seam, [x for x in at if seam <= x <= seam + overlap], [x for x in at if x >= after]

        yield from batches_of(found(), schema, 200)

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted({(seam, tuple(a), tuple(b)) for _, seam, a, b in rows_of(table.to_batches())})
        kept, cuts, again = stitch(rows)
        return pa.table({"key": [key[0].as_py()], "seams": pa.array([kept], pa.list_(pa.int32())), "cuts": pa.array([cuts], pa.list_(pa.int32())), "again": [again]})

    done: DataFrame | None = None
    while True:
        length = F.length("text")
        ends = F.transform("seams", lambda s, i: F.struct(s.alias("seam"), F.coalesce(F.get("seams", i + 1), length).alias("after"), F.greatest(s - overlap, F.lit(0)).alias("start")))
        opened = one.join(seams, "key").select("key", "text", F.explode(ends).alias("w")).select("key", "w.*", (F.col("w.after") + overlap >= length).alias("last"), F.substring("text", F.col("w.start") + 1, F.col("w.after") + overlap - F.col("w.start")).alias("window"))
        read = opened.repartition("key", "seam").mapInArrow(pretokenise, "key string, seam int, by_start array<int>, by_end array<int>")
        state = materialize(read.groupBy("key").applyInArrow(cut, "key string, seams array<int>, cuts array<int>, again boolean"), "cuts")
        fresh = state.where("not again").select("key", "cuts")
        done = fresh if done is None else done.unionByName(fresh)
        seams = state.where("again").select("key", "seams")
        if seams.isEmpty():
            return done


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) → (doc_id, ids, bytes): the raw bytes of the ids, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_file(ranks, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])
        yield from batches_of(((d, ids, encoder.decode(ids)) for d, ids in rows_of(batches)), schema, 200)

    return encoded.mapInArrow(run, "doc_id long, ids binary, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and bytes."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
