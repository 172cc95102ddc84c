"""Near duplicates by bottom-k sketches: MinHash with one hash function.

A document's sketch are the k smallest hashes of its set of word shingles. The k smallest of two sketches' union are a
sample of the union of the sets; how many of them both sketches have estimates the sets' similarity. The same holds the
other way: similar sets share many retained values, at least `needed` of them but for a chance of MISS a pair (sets
that a sketch holds whole are counted exactly). So of a sketch's values in order of their frequency, rare ones first, those
before the last `needed` - 1 go into inverted lists, and similar documents meet in one; values that a passage has
spread over the corpus come late in this order. In a list the overlaps of sketches are counted, the estimate from the union
sketch filters, and the exact similarity of the whole sets decides.

Equal sets are one class, compared once. A group of m near copies has m^2 pairs, which components do not need: each list
is compared with its head first, then only lists whose documents are in different components still, in pairs of blocks.
Lists longer than a small share of all postings are few, and are joined by broadcast; the others by shuffle.

Defined cases: a null or wordless text has no shingles and links with nothing; equal sets link; rows that share
an id are one document; rows without an id link with nothing and have no component; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected
from .jaccard import SALTS, _classes, links, similar
from .shingles import mix, shingle_sets

#: Values of a sketch, and the chance that a similar pair is not compared.
K, MISS = 64, 1e-9
#: Members compared with one head in a task, members of a block of a list, lists that a broadcast may hold.
MEMBERS, BLOCK, HEAVY = 256, 512, 1 << 16


def needed(k: int, num: int, den: int, miss: float = MISS) -> int:
    """How many of k values of a union both sets have at least, if num / den of the union is in both; less with that chance."""
    p, below = num / den, 0.0
    for y in range(k + 1):
        below += comb(k, y) * p**y * (1 - p) ** (k - y)
        if below > miss:
            return y
    return k


def prefix_sizes(k: int, num: int, den: int) -> list[int]:
    """By the size of a set (all from k on are alike): how many of its rarest values similar sets must meet."""
    least = needed(k, num, den)
    return [n - min(-(-num * n // den), n if n * den <= num * k else least) + 1 if n else 0 for n in range(k + 1)]


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n, hi, lo, sketch): size and 128-bit digest of the set, its k smallest hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(h), mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), h[:k].view(np.int64).copy()) for h in shingle_sets(batch.column(1), words)]
            n, hi, lo, low = zip(*sets, strict=True) if sets else ((), (), (), ())
            cols = [batch.column(0), pa.array(n, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, hi long, lo long, sketch array<long>")


def by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with facts (a row a key, with the number of its rows): keys with more than 1 / HEAVY of all rows, fewer
    than HEAVY by that, are broadcast; no key that is shuffled has more."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy, light = facts.where(F.col(count) > total / HEAVY), facts.where(F.col(count) <= total / HEAVY)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(light, key))


def prefixes(reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row, n, doc_id, prefix): of each sketch's prefix the values that other documents have too, rare ones first."""
    values = reps.select("row", F.explode("sketch").alias("value"))
    often = materialize(values.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "often")
    shared = by_key(values, often, "value", "c").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("shared"))  # k at most
    sizes = F.array(*map(F.lit, prefix_sizes(k, num, den)))
    left = F.get(sizes, F.least(F.col("n"), F.lit(k))) - (F.size("sketch") - F.size("shared"))  # values of one document are the rarest
    both = reps.join(shared, "row").select("row", "n", "doc_id", F.slice("shared", F.lit(1), F.greatest(left, F.lit(0))).alias("shared"))
    out = materialize(both.select("row", "n", "doc_id", F.col("shared.value").alias("prefix")), "prefixes")
    discard(often)
    return out


def estimates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of both, values) among the k smallest of the unions of sketches; rows of x and y are sorted sketches of k."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    place = np.arange(2, both.shape[1] + 1) - np.cumsum(twice, axis=1)  # of a repeated value among the different ones
    padded = (both >= _PAD).sum(1)
    return (twice & (place <= k)).sum(1), np.minimum(k, both.shape[1] - twice.sum(1) - padded)


#: What fills short sketches up to k: above all hashes but for a chance of 2^-56, other ones in x than in y.
_PAD = np.uint64(2**64 - 256)


def table(sketches_: list[np.ndarray], k: int, odd: int) -> np.ndarray:
    """Sketches as rows of k, short ones filled up."""
    out = np.tile(_PAD + np.arange(k, dtype=np.uint64) * np.uint64(2) + np.uint64(odd), (len(sketches_), 1))
    for row, sketch in zip(out, sketches_, strict=True):
        row[: len(sketch)] = sketch
    return out


def passing(x: list[np.ndarray], y: list[np.ndarray], n: np.ndarray, m: np.ndarray, k: int, num: int, den: int, least: np.ndarray) -> np.ndarray:
    """Which pairs of sketches of sets of sizes n and m may be of similar sets: the union sketch has enough values of both;
    sets that sketches hold whole are compared exactly."""
    if not len(x):
        return np.zeros(0, bool)
    shared, of = estimates(table(x, k, 0), table(y, k, 1), k)
    whole = np.maximum(n, m) <= k
    exact = np.array([len(np.intersect1d(a, b)) if w else 0 for a, b, w in zip(x, y, whole, strict=True)])
    return np.where(whole, den * exact >= num * (n + m - exact), shared >= least[of])


def promising(pairs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows of reps whose sketches may be of similar sets, as doc_ids. A head meets its members in parts."""
    least = np.array([needed(i, num, den) for i in range(k + 1)])
    sizes = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = by_key(pairs, sizes, "a", "c").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / MEMBERS)).cast("int").alias("part"))
    dealt = materialize(dealt, "dealt")
    heads = dealt.select("a", "part").distinct().select(F.col("a").alias("row"), "a", "part", F.lit(True).alias("head"))
    roles = heads.unionByName(dealt.select(F.col("b").alias("row"), "a", "part", F.lit(False).alias("head")))
    both = roles.join(reps.select("row", "doc_id", "n", "sketch"), "row").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            met: list[tuple] = []
            for is_head, doc_id, n, sketch in zip(*(batch.column(i).to_pylist() for i in range(3)), unsigned(batch.column(3)), strict=True):
                if is_head:
                    head = (doc_id, n, sketch)
                elif doc_id != head[0]:
                    met.append((*head, doc_id, n, sketch))
            a, n, x, b, m, y = zip(*met, strict=True) if met else ((),) * 6
            kept = np.flatnonzero(passing(x, y, np.array(n), np.array(m), k, num, den, least))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[kept]) for c in (a, b)], ["a", "b"])

    return both.select("head", "doc_id", "n", "sketch").mapInArrow(run, "a long, b long")


def unsigned(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy().view(np.uint64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): links are den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(sketches(docs, words, k), "sketches")
    sets = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = materialize(_classes(sets), "classes")
    own = sets.join(classes, ["hi", "lo", "salt"])
    reps = own.where("doc_id = rep").dropDuplicates(["hi", "lo"])
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "sketch"), "reps")
    rare = prefixes(reps, k, num, den)
    posts = rare.select("row", "n", "doc_id", F.posexplode("prefix").alias("at", "value"))
    heads = posts.groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("at", "row", "n")).alias("head")).where("c > 1")
    heads = materialize(heads.select("value", "c", F.col("head.row").alias("head"), F.col("head.n").alias("head_n")), "heads")
    near = (F.col("n") * den >= F.col("head_n") * num) & (F.col("head_n") * den >= F.col("n") * num)
    stars = by_key(posts, heads, "value", "c").where((F.col("row") != F.col("head")) & near).select(F.col("head").alias("a"), F.col("row").alias("b"))
    stars = materialize(stars.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a")).select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b")), "stars")
    found = links(promising(stars, reps, k, num, den), docs, words, num, den)
    copies = own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    twice = sets.where("n > 0").groupBy("doc_id").agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least <> most").select("doc_id")  # ids of several texts
    twice = own.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = materialize(found.unionByName(copies).unionByName(twice), "edges")
    parts = materialize(connected(edges), "components")
    rest = materialize(across(rare, parts, reps, k, num, den), "rest")
    if not rest.isEmpty():
        more = materialize(verified(rest, docs, words, num, den), "edges")
        if not more.isEmpty():
            before, parts = parts, materialize(connected(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)), "components")
            discard(before)
        discard(more)
    for done in (rare, heads, stars, edges, rest, reps):
        discard(done)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "salt", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "hi", "lo", "salt").join(of_class, ["hi", "lo", "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


_GROUP = "value long, i int, j int, members array<long>, x array<int>, y array<int>"


def across(rare: DataFrame, parts: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs of doc_ids that share a list but lie in different components and may be similar, each once: a row for each
    group (value, i, j) that has some, with its members and the pairs x, y as places among them.

    A list is dealt into blocks by a hash of the member, and each pair of blocks is a task's group: it holds two blocks
    of sketches and gives out the pairs that pass the estimate, each in the list of its smallest common value."""
    least = np.array([needed(i, num, den) for i in range(k + 1)])
    own = rare.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    own = materialize(own.select("row", "doc_id", "n", "component", "prefix"), "named")
    named = own.select("row", "component", F.explode("prefix").alias("value"))
    split = named.groupBy("value").agg(F.count("*").alias("c"), F.min("component").alias("least"), F.max("component").alias("most")).where("c > 2 and least <> most")
    split = materialize(split.select("value", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "split")
    rows = by_key(named.drop("component"), split, "value", "c").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    low = rows.select("value", "row", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("first"))
    high = rows.where("block > 0").select("value", "row", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("first"))
    both = low.unionByName(high).join(own.join(reps.select("row", "sketch"), "row"), "row")
    both = both.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", F.desc("first"))

    schema = pa.schema([("value", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("members", pa.list_(pa.int64())), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))])

    def told(group: tuple | None, members: list[list]) -> Iterator[pa.RecordBatch]:
        if found := compared(group, members, k, num, den, least):
            ids, at = np.unique(np.array(found, np.int64), return_inverse=True)
            at = at.reshape(-1, 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*group, ids, at[:, 0], at[:, 1]), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(7)), unsigned(batch.column(7)), unsigned(batch.column(8)), strict=True)
            for value, i, j, *member in keys:
                if group != (value, i, j):
                    yield from told(group, members)
                    group, members = (value, i, j), []
                members.append(member)
        yield from told(group, members)

    return both.select("value", "i", "j", "first", "component", "doc_id", "n", "prefix", "sketch").mapInArrow(run, _GROUP)


def verified(groups: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of groups whose whole sets are similar enough. A group's texts come to it once each, however many
    pairs they are in; ids of several texts are compared by all of them."""
    need = groups.select("value", "i", "j", F.explode("members").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(need.hint("merge"), "doc_id").select("value", "i", "j", "doc_id", "text")
    none = F.lit(None)
    heads = groups.select("value", "i", "j", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "members", "x", "y")
    rows = texts.select("*", *(none.cast(t).alias(c) for c, t in (("members", "array<long>"), ("x", "array<int>"), ("y", "array<int>"))))
    both = heads.unionByName(rows).repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", F.asc_nulls_first("doc_id"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judged(pairs: tuple | None, sets: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pairs is not None:
            members, x, y = pairs
            known = [(members[p], members[q]) for p, q in zip(x, y, strict=True)]
            found = [(a, b) for a, b in known if any(similar(u, v, num, den) for u in sets.get(a, ()) for v in sets.get(b, ()) if len(u) and len(v))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sets = None, {}
        for batch in batches:
            for row, h in enumerate(shingle_sets(batch.column(4), words)):
                doc_id = batch.column(3)[row].as_py()
                if doc_id is None:
                    yield from judged(pairs, sets)
                    pairs, sets = tuple(batch.column(c)[row].as_py() for c in (5, 6, 7)), {}
                else:
                    sets.setdefault(doc_id, []).append(h)
        yield from judged(pairs, sets)

    return both.mapInArrow(run, "a long, b long")


def incidence(sets: list[np.ndarray], below: int | None = None) -> np.ndarray:
    """Rows of 0 and 1: which of the values of two sets or more (smaller than `below`) each set has."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if below is not None:
        flat, owner = flat[flat < np.uint64(below)], owner[flat < np.uint64(below)]
    values, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    column[often > 1] = np.arange(int((often > 1).sum()))
    has = np.zeros((len(sets), int((often > 1).sum())), np.float32)
    at = column[at]
    has[owner[at >= 0], at[at >= 0]] = 1
    return has


def compared(group: tuple | None, members: list[list], k: int, num: int, den: int, least: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a group's blocks in different components whose overlaps and estimates are high enough, smaller id first."""
    if group is None or len({m[1] for m in members}) < 2:
        return []
    first, component, ids, n = (np.array([m[c] for m in members]) for c in range(4))
    sketch = [m[5] for m in members]
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if group[1] != group[2] else (np.arange(len(members)),) * 2
    has, earlier = incidence(sketch), incidence([m[4] for m in members], group[0] % 2**64)
    overlap, x, y = has[left] @ has[right].T, n[left][:, None], n[right][None, :]
    need = np.where(np.maximum(x, y) <= k, np.minimum(x, y) * num / den, np.minimum(least[k], np.minimum(x, y) * num / den))
    maybe = (overlap >= need - 1e-6) & (component[left][:, None] != component[right][None, :]) & (x * den >= y * num) & (y * den >= x * num)
    maybe &= (earlier[left] @ earlier[right].T == 0) & ((group[1] != group[2]) | (left[:, None] < right[None, :]))
    a, b = np.nonzero(maybe)
    a, b = left[a], right[b]
    out: set[tuple[int, int]] = set()
    for at in range(0, len(a), 4096):
        p, q = a[at : at + 4096], b[at : at + 4096]
        kept = passing([sketch[i] for i in p], [sketch[i] for i in q], n[p], n[q], k, num, den, least) & (ids[p] != ids[q])
        out.update(zip(np.minimum(ids[p], ids[q])[kept].tolist(), np.maximum(ids[p], ids[q])[kept].tolist(), strict=True))
    return sorted(out)
