"""N-gram Jaccard join by rare-first prefix filtering.

A document is its set of word shingles. All shingles have one order: by how often their bucket of a fixed number of
counters occurs in the corpus, rare ones first, ties by hash; the counters are summed over all documents and are the
one thing broadcast, always of the same size. Two sets of the wanted similarity share a shingle within the
prefixes of this order, so prefix shingles are exploded and joined. Pairs must pass the length filter and the positional
filter at the shared shingle, then the suffix filter (counts of hash ranges bound the difference) before their
whole sets are compared, once a pair.

A group of m near copies has m^2 pairs, which components do not need: first each posting list is compared with its head
(the document in which the shingle comes earliest), then only pairs that still are in different components and share
a list of three or more are compared, by pairs of blocks of the list. Every link between different components is found this way, so the components
are exact.

Defined cases: a null or wordless text has no shingles and links with nothing; equal sets link; rows that share
an id are one document; rows without an id link with nothing and have no component; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of
from .components import connected
from .shingles import mix, shingle_sets

#: log2 of the counters, and of the counters in a row; partial tables of a block that one task sums.
COUNTER_BITS, ROW_BITS, FAN_IN = 20, 14, 512
#: Members compared with one head in a task, members of a block of a posting list, sets that a task remembers, parts of a group of equal sets.
MEMBERS, BLOCK, REMEMBERED, SALTS = 64, 256, 1 << 17, 256


def occurrences(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall into each counter."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for hashes in shingle_sets(batch.column(0), words):
                np.add.at(counts, (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        yield from _sparse(counts)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for block, at, n in rows_of(batches):
            row = sums.setdefault(block, np.zeros(1 << ROW_BITS, np.uint64))
            row[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for block, row in sums.items():
            at = np.flatnonzero(row)
            yield _row([block], [at.astype(np.uint16).tobytes()], [np.minimum(row[at], 2**32 - 1).astype(np.uint32).tobytes()])

    ddl = "block int, at binary, n binary"
    parts = docs.select("text").mapInArrow(count, ddl)
    tasks, blocks = docs.rdd.getNumPartitions(), 1 << (COUNTER_BITS - ROW_BITS)
    while tasks > FAN_IN:  # a tree of sums, as no task should read a row of every other
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("salt", (F.rand(5) * tasks).cast("int")).repartition(min(blocks * tasks, 10_000), "block", "salt").drop("salt").mapInArrow(add, ddl)
    out = np.zeros(1 << COUNTER_BITS, np.uint32)
    for block, at, n in parts.repartition(blocks, "block").mapInArrow(add, ddl).collect():  # always 2^20 counters at most
        out[(block << ROW_BITS) + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(n, np.uint32)
    return out


def _sparse(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block, row in enumerate(counts.reshape(-1, 1 << ROW_BITS)):
        if (at := np.flatnonzero(row)).size:
            yield _row([block], [at.astype(np.uint16).tobytes()], [row[at].tobytes()])


def _row(block: list, at: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["block", "at", "n"])


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def shingle_prefixes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, hi, lo, prefix): set size, 128-bit digest of the set, prefix (null if the task has just had the set)."""
    counts = docs.sparkSession.sparkContext.broadcast(occurrences(docs, words))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = counts.value, set()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                key = (int(mix(h).sum()), int(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())) if len(h) else (0, 0)
                key = tuple(k - 2**64 if k >= 2**63 else k for k in key)
                prefix = None
                if len(h) and doc_id is not None and key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    order = np.lexsort((h, often[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                    prefix = h[order[: prefix_length(len(h), num, den)]].view(np.int64)
                for col, x in zip(cols, (doc_id, len(h), *key, prefix), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, hi long, lo long, prefix array<long>")


def _possible(n: Column, pos: Column, m: Column, at: Column, num: int, den: int) -> Column:
    """Length filter, and the positional filter at a shared shingle."""
    need = F.ceil((n + m) * num / float(num + den) - 1e-9)
    return (n * den >= m * num) & (m * den >= n * num) & (F.least(n - pos, m - at) >= need)


def links(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. A head's text meets its members' in parts of MEMBERS pairs.

    Texts move twice: once to meet their roles in the pairs, once to their groups. The hint keeps that plan at all sizes."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    dealt = materialize(dealt.select("a", "b", "part"), "pairs")
    head = dealt.select("a", "part").distinct().select(F.col("a").alias("doc_id"), "a", "part", F.lit(True).alias("head"))
    roles = head.unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(False).alias("head")))
    both = docs.select("doc_id", "text").join(roles.hint("merge"), "doc_id").select("a", "part", "head", "doc_id", "text")
    both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            sets = shingle_sets(batch.column(4), words)
            for a, part, is_head, b, h in zip(*(batch.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if group != (a, part):
                    group, heads = (a, part), []
                if is_head:
                    heads.append(h)
                elif any(similar(x, h, num, den) for x in heads):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], schema=schema)

    return both.mapInArrow(run, "a long, b long")


_EDGES = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union of two sorted sets; the suffix filter comes first."""
    need = -(-num * (len(x) + len(y)) // (num + den))
    most_apart = len(x) + len(y) - 2 * need
    if min(len(x), len(y)) < need:
        return False
    cut = lambda s: np.diff(np.searchsorted(s, _EDGES), prepend=0, append=len(s))
    if np.abs(cut(x) - cut(y)).sum() > most_apart:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum()) >= need


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): links are den * intersection >= num * union."""
    docs = docs.select("doc_id", "text")
    sets = materialize(shingle_prefixes(docs, words, num, den), "sets")
    sets = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = materialize(_classes(sets), "classes")
    posts = sets.where("prefix is not null").select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    heads = posts.groupBy("token").agg(F.count("*").alias("c"), F.min_by("doc_id", "pos").alias("head"), F.min_by("n", "pos").alias("head_n"), F.min("pos").alias("head_pos")).where("c > 1")
    shared = materialize(posts.join(heads, "token").select("token", "doc_id", "n", "pos", "head", "head_n", "head_pos", "c"), "shared")
    near = _possible(F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_pos"), num, den)
    stars = shared.where((F.col("doc_id") != F.col("head")) & near).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    stars = materialize(stars.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a")).select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b")), "stars")  # a pair once, under one of its heads
    lists = shared.where("c > 2").select("token", "doc_id", "n", "pos", "head", "c")
    first = links(stars, docs, words, num, den)
    copies = sets.where("prefix is not null").select("doc_id", "hi", "lo", "salt").join(classes, ["hi", "lo", "salt"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    twice = sets.where("n > 0").groupBy("doc_id").agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least <> most").select("doc_id")  # ids of several texts
    twice = sets.where("n > 0").join(twice, "doc_id").select("doc_id", "hi", "lo", "salt").join(classes, ["hi", "lo", "salt"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = materialize(first.unionByName(copies).unionByName(twice), "edges")
    parts = materialize(connected(edges), "components")
    rest = materialize(_across(lists, parts, stars, num, den), "rest")
    if not rest.isEmpty():
        more = materialize(links(rest, docs, words, num, den), "edges")
        if not more.isEmpty():
            parts = materialize(connected(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)), "components")
    for done in (shared, stars, edges, rest):
        discard(done)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "salt", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "hi", "lo", "salt").join(of_class, ["hi", "lo", "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _classes(sets: DataFrame) -> DataFrame:
    """(hi, lo, salt, rep): the smallest id of each set's documents, beside every salt that they have.

    A large group of equal sets meets its representative salt by salt, so no task has it whole."""
    dealt = sets.where("n > 0 and doc_id is not null").groupBy("hi", "lo", "salt").agg(F.min("doc_id").alias("least"))
    return dealt.select("hi", "lo", "salt").join(dealt.groupBy("hi", "lo").agg(F.min("least").alias("rep")), ["hi", "lo"])


def _across(lists: DataFrame, parts: DataFrame, stars: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a posting list that lie in different components and were not compared before, each once.

    A list of c members is dealt into blocks by a hash of the member; each pair of blocks is a key of its own, so a
    task holds two blocks of BLOCK members, however long a list is."""
    named = lists.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    split = named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(blocks).alias("blocks")).where("least <> most")
    split = split.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = named.where("doc_id <> head").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")}).join(split, ["token", "block"], "left_semi")
    member = ("token", "doc_id", "n", "pos", "component")
    x = rows.select(*member, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j")).alias("x")
    y = rows.select(*member, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j")).alias("y")
    near = _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & once & (F.col("x.component") != F.col("y.component")) & near
    pairs = x.join(y, on).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component, that of the smallest id; rows without an id stay; all columns stay.

    Rows that share that id are versions of one document: the first by text (nulls last), then by the other columns, stays."""
    grouped = near_duplicates(docs, words, num, den).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(grouped, "doc_id", "left_semi")
    others = [F.to_json(F.struct(c)) for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), *others)
    version = next(name for i in range(len(docs.columns) + 1) if (name := f"_version{i}") not in {c.lower() for c in docs.columns})
    kept = kept.withColumn(version, F.row_number().over(first)).where(F.col(version) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
