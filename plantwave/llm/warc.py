"""Merkle fixity audit of WARC replicas.

A record's digest is the SHA-256 of its block; the records of an archive lie at byte offsets. A replica is read at the
offsets of the primary's index, so a lost record is a gap in its own place and moves nothing behind it. Leaves of the
tree are ordered offset ranges of an archive, hashed over id, copy, offset, length and digest of each record; a node's
hash is the SHA-256 of its children's hashes in order, and the archives' roots go on into one collection tree. Two
replicas compare their roots; only children of mismatching nodes are joined on the next level, down to the ranges
and at last to the records in them.

Defined cases: a null text is an empty block; rows without an id lie in archives below zero, dealt by digest; repeated
rows are records of their own (told apart by their number among equal ids); equal replicas and empty tables give
an empty result; columns beyond id and text are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Ids to an archive, bytes to a range, children to a node.
IDS_PER_ARCHIVE, RANGE_BYTES, FANOUT = 256, 65_536, 16


def record_header(record_id: Column, length: Column) -> Column:
    """The WARC header block of a resource record."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:doc:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def manifest(docs: DataFrame, ids_per_archive: int = IDS_PER_ARCHIVE, stored: Column | None = None) -> DataFrame:
    """Records (archive, doc_id, copy, offset, length, digest) of documents written to archives in order of their ids.

    An archive takes the ids of one range, so no window spans more than ids_per_archive ids; texts stay in the scan.
    stored: the block that a replica holds in the record's place (null: none); its digest comes as stored_digest."""
    text = F.coalesce("text", F.lit(""))
    block = F.octet_length(text)
    held = () if stored is None else (F.sha2(stored.cast("binary"), 256).alias("stored_digest"),)
    records = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), (F.octet_length(record_header(F.col("doc_id"), block)) + block + 4).cast("long").alias("length"), *held)
    by_digest = -1 - F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    records = records.withColumn("archive", F.coalesce(F.expr(f"(doc_id - pmod(doc_id, {ids_per_archive})) div {ids_per_archive}"), by_digest).cast("long"))
    ties = [c for c in ("digest", "length", "stored_digest") if c in records.columns]
    order = Window.partitionBy("archive").orderBy("doc_id", *ties)
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    copy = F.row_number().over(Window.partitionBy("archive", "doc_id").orderBy(*ties))
    return records.select("archive", "doc_id", copy.alias("copy"), (end - F.col("length")).alias("offset"), "length", "digest", *ties[2:])


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The primary and the replica of a manifest with stored_digest."""
    return records.drop("stored_digest"), records.drop("digest").withColumnRenamed("stored_digest", "digest")


def _joined(order: str, *of: str) -> Column:
    """SHA-256 over the hashes of a group, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*dict.fromkeys((order, *of))))), lambda x: F.concat_ws(":", *(x[c] for c in of))), "\n"), 256)


def ranges(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Leaves: (archive, node, hash) of the offset ranges. All fields of a record count; a null digest is a missing one."""
    fields = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "copy", "offset", "length", "digest")))
    return records.withColumns({"node": F.floor(F.col("offset") / range_bytes), "item": fields}).groupBy("archive", "node").agg(_joined("offset", "item").alias("hash"))


def parents(nodes: DataFrame, fanout: int, keys: tuple[str, ...]) -> DataFrame:
    up = nodes.withColumns({"parent": F.floor(F.col("node") / fanout)})
    return up.groupBy(*keys, "parent").agg(_joined("node", "node", "hash").alias("hash")).select(*keys, F.col("parent").alias("node"), "hash")


def height(nodes: int, fanout: int) -> int:
    """Levels above numbers 0..nodes until one node is left."""
    n = 0
    while nodes:
        nodes, n = nodes // fanout, n + 1
    return n


def tree(leaves: DataFrame, inner: int, outer: int, fanout: int) -> DataFrame:
    """All nodes (level, side, archive, node, hash) over leaves (side, archive, node, hash), in one written table.

    Levels 0..inner are nodes of an archive, the higher ones nodes of the collection; each level reuses the
    shuffle of the one below."""
    at = leaves.select("side", "archive", "node", "hash")
    levels = [at]
    for _ in range(inner):
        levels.append(at := parents(at, fanout, ("side", "archive")))
    at = at.select("side", _natural(F.col("archive")).alias("node"), "hash")
    for n in range(outer + 1):
        at = parents(at, fanout, ("side",)) if n else at
        levels.append(at.select("side", F.lit(0).cast("long").alias("archive"), "node", "hash"))
    rows = [x.select(F.lit(n).alias("level"), "side", "archive", F.col("node").cast("long").alias("node"), "hash") for n, x in enumerate(levels)]
    return materialize(functools.reduce(DataFrame.unionAll, rows), "tree")


def _natural(archive: Column) -> Column:
    """Archive numbers of either sign as 0, 1, 2, ...: zigzag."""
    return F.when(archive >= 0, 2 * archive).otherwise(-2 * archive - 1)


def descend(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """(mismatching ranges (archive, node), nodes that were compared on all levels)."""
    both = [ranges(x, range_bytes).select(F.lit(n).alias("side"), "archive", "node", "hash") for n, x in enumerate((primary, replica))]
    leaves = materialize(both[0].unionAll(both[1]), "ranges")
    top = leaves.agg(F.max("node"), F.max(_natural(F.col("archive")))).first()
    inner, outer = (height(n or 0, fanout) for n in top)
    nodes = tree(leaves, inner, outer, fanout)
    discard(leaves)
    bad: DataFrame | None = None
    visited = 0
    for at in range(inner + 1 + outer, -1, -1):
        ours, theirs = (nodes.where((F.col("level") == at) & (F.col("side") == n)).select("archive", "node", F.col("hash").alias(name)) for n, name in enumerate(("ours", "theirs")))
        if bad is not None:
            ours, theirs = (_below(x, bad, at == inner, fanout) for x in (ours, theirs))
        met = ours.join(theirs, ["archive", "node"], "full")
        seen = materialize(met.select("archive", "node", F.col("ours").eqNullSafe(F.col("theirs")).alias("same")), "compared")
        visited += seen.count()
        bad = seen.where("not same").select("archive", "node")
    return bad, visited


def _below(level: DataFrame, bad: DataFrame, roots: bool, fanout: int) -> DataFrame:
    """The children of mismatching nodes; roots: from the collection's leaves to the archives' roots."""
    if roots:
        return level.join(bad.select(F.col("node").alias("root")), _natural(F.col("archive")) == F.col("root"), "left_semi")
    parent = bad.select("archive", F.col("node").alias("parent"))
    return level.withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["archive", "parent"], "left_semi").drop("parent")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two manifests: (archive, doc_id, copy, offset, length, status changed|missing|extra).

    Both are (archive, doc_id, copy, offset, length, digest); an unreadable record has a null digest."""
    bad, _ = descend(primary, replica, range_bytes, fanout)
    ranged = lambda x: x.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["archive", "node"], "left_semi")
    key = ["archive", "doc_id", "copy"]
    a, b = (ranged(x).select(*key, "offset", "length", "digest", F.lit(True).alias("there")).alias(n) for x, n in ((primary, "a"), (replica, "b")))
    joined = a.join(b, (F.col("a.archive") == F.col("b.archive")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.copy") == F.col("b.copy")), "full")
    moved = ~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & (F.col("a.offset") == F.col("b.offset")) & (F.col("a.length") == F.col("b.length")))
    status = F.when(F.col("b.there").isNull() | F.col("b.digest").isNull() & F.col("a.digest").isNotNull(), "missing").when(F.col("a.there").isNull() | F.col("a.digest").isNull() & F.col("b.digest").isNotNull(), "extra").when(moved, "changed")
    out = joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*key, "offset", "length")), status.alias("status"))
    return out.where("status is not null")
