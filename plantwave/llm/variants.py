"""Spelling variants: words one edit apart, found by pivotal grams, grouped under their most frequent form.

The bigrams of a word are ordered by how often they occur in all words, rare ones first. Its prefix are the bigrams up to
the third of this order (all that tie with it); its two pivots are the two disjoint bigrams of the prefix that occur least,
chosen by dynamic programming. Of two words one edit apart take the one whose prefix ends earlier: the edit
spoils at most one of its pivots, the other one stands in the other word, in its prefix, as far from the side
that the edit left alone. An edit left of the second pivot leaves all from there to the end alone, any other all from
the start to the first pivot: so the first pivot is filed with what stands before it, the second with what stands after
it, and prefix grams are filed both ways. What lies on the edited side has one edit in one of its halves, so the other
half is filed with the gram too. Pivots meet prefix grams of the same file, and Levenshtein distances decide.

Words are rows of Spark tables all along; only the counts of bigrams, at most the square of the alphabet, go to the tasks.

Defined cases: null and empty texts have no words; a null id counts as the empty string before the colon; repeated
rows count again; equal counts go by the order of code points; an empty table gives an empty result; further columns
are ignored; words of more than LONG letters go by their digest until the distances are taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .shingles import line_hashes, mix

#: Letters that stand for themselves in the candidates; longer words by their digest.
LONG = 64
#: a-z and U+00C0 to U+00FF.
ALPHABET = 26 + 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 7, least_n: int = 2, damage: int | None = None) -> DataFrame:
    """(word, n) of the letter runs of docs (doc_id, text) in lower case (A-Z only), of at least that length and count.

    With `damage`, a run whose checksum with its document's id is a multiple of it loses one letter, which the checksum names."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"([a-z\\u00C0-\\u00FF]{{{least_length},}})"), 1)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if damage:
        found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        found = found.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("run")).where(F.length("run") >= least_length)
    return found.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Grams:
    """The bigrams of words, end to end: letters, where each word starts and ends, and each bigram's place, word and code."""

    def __init__(self, words: pa.Array) -> None:
        texts = words.to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.letters = np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        owner = np.repeat(np.arange(len(texts)), self.size)
        self.at = np.flatnonzero(np.arange(len(owner)) + 1 != self.end[owner])
        self.word = owner[self.at]
        self.code = self.letters[self.at].astype(np.int64) * ALPHABET + self.letters[self.at + 1] if len(self.at) else np.zeros(0, np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each bigram occurs in the words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALPHABET**2, np.int64)
        for batch in batches:
            counts += np.bincount(Grams(batch.column(0)).code, minlength=ALPHABET**2)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["gram", "n"])

    out = np.zeros(ALPHABET**2, np.int64)
    for gram, n in words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():  # 8100 rows at most
        out[gram] = n
    return out


def pivots(at: list[int], weight: list[int]) -> tuple[int, int]:
    """Which two of a prefix's bigrams (places rising) are disjoint and weigh least together.

    The best pair that ends at a bigram is that bigram and the lightest one two places before it or earlier."""
    best, cost, lightest, seen = (-1, -1), None, -1, 0
    for j, place in enumerate(at):
        while at[seen] <= place - 2:
            if lightest < 0 or weight[seen] < weight[lightest]:
                lightest = seen
            seen += 1
        if lightest >= 0 and (cost is None or weight[lightest] + weight[j] < cost):
            best, cost = (lightest, j), weight[lightest] + weight[j]
    return best


def prefixes(grams: Grams, counts: np.ndarray) -> np.ndarray:
    """Numbers of the bigrams that are in their words' prefixes, places rising."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    own = rank[grams.code]
    order = np.lexsort((own, grams.word))
    third = own[order[grams.start - np.arange(len(grams.start)) + 2]]
    return np.flatnonzero(own <= third[grams.word])


def chosen(grams: Grams, prefix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second pivot of each word."""
    at, weight = grams.at[prefix].tolist(), counts[grams.code[prefix]].tolist()
    cuts = np.searchsorted(grams.word[prefix], np.arange(len(grams.size) + 1)).tolist()
    found = [(a + i, a + j) for a, b in zip(cuts, cuts[1:], strict=False) for i, j in [pivots(at[a:b], weight[a:b])]]
    first, second = np.array(found, np.int64).reshape(-1, 2).T
    return prefix[first], prefix[second]


def files(grams: Grams, which: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, file) of bigrams: the file hashes the untouched side, the bigram's place on it and one half of the other side.

    Lengths of the other side that differ by one share a half of some size, so up to two sizes of a half are filed."""
    a, w = grams.at[which], grams.word[which]
    start, end = grams.start[w], grams.end[w]
    rest = end - a - 2 if left else a - start
    short = np.maximum(rest - 1, 0)
    near, far = (short // 2, rest // 2), (short - short // 2, rest - rest // 2)
    low, high = (start, a + 2) if left else (a, end)
    begins, ends, owners, pairs = [low], [high], [], []
    always = np.ones(len(a), bool)
    for size, once in ((near[0], always), (near[1], near[1] != near[0])):
        pairs.append((once, (low, high + size) if left else (low - size, high), None))
    for size, once in ((far[0], far[0] > 0), (far[1], (far[1] > 0) & (far[1] != far[0]))):
        pairs.append((once, (low, high), (end - size, end) if left else (start, start + size)))
    for once, (x, y), other in pairs:
        u, v = other if other is not None else (x, x)
        begins += [x[once], u[once]]
        ends += [y[once], v[once]]
        owners.append(w[once])
    hashes = line_hashes(grams.letters, np.concatenate(begins[1:]), np.concatenate(ends[1:]))
    keys, seen = [], 0
    for k, (once, _, other) in enumerate(pairs):
        n = int(once.sum())
        one, two = hashes[seen : seen + n], hashes[seen + n : seen + 2 * n]
        seen += 2 * n
        place = (a - start if left else end - a)[once].astype(np.uint64)
        tag = np.uint64(1 + left + 2 * (other is not None))
        keys.append(mix(mix(one + tag) + (two if other is not None else np.uint64(0)) + place * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(owners), np.concatenate(keys)


def filed(words: DataFrame, counts: np.ndarray, pivotal: bool) -> DataFrame:
    """(file, name): of the pivots of words (word, name), or of all grams of their prefixes."""
    ranks = words.sparkSession.sparkContext.broadcast(counts)  # 8100 numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch.column(0))
            prefix = prefixes(grams, ranks.value)
            first, second = chosen(grams, prefix, ranks.value) if pivotal else (prefix, prefix)
            for which, left in ((first, True), (second, False)):
                owner, key = files(grams, which, left)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).take(pa.array(owner))], ["file", "name"])

    return words.select("word", "name").mapInArrow(run, "file long, name string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of the names of the words (word, name) that are one inserted, deleted or replaced letter apart, each once.

    Needs words of four letters or more, as three bigrams make a prefix."""
    counts = gram_counts(words)
    x, y = filed(words, counts, True), filed(words, counts, False)
    x, y = x.select("file", F.col("name").alias("a")), y.select("file", F.col("name").alias("b"))
    digest = lambda c: F.startswith(F.col(c), F.lit("#"))
    apart = (F.col("a") != F.col("b")) & F.when(digest("a") | digest("b"), True).otherwise(one_edit("a", "b"))
    met = x.join(y, "file").where(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = materialize(met, "near")
    long = met.where(digest("a") | digest("b"))
    full = words.where(F.length("word") >= LONG).select("word", "name")
    long = long.join(full.select(F.col("name").alias("a"), F.col("word").alias("x")), "a").join(full.select(F.col("name").alias("b"), F.col("word").alias("y")), "b")
    return met.where(~(digest("a") | digest("b"))).unionByName(long.where(one_edit("x", "y")).select("a", "b"))


def one_edit(x: str, y: str) -> Column:
    return (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(F.col(x), F.col(y), 1) == 1)


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is its near word of largest n (ties: smallest), if that n is at least `factor` times its own (2 or more,
    so forms end); its root is where forms lead to. A form's n grows by that factor, so few rounds that double the way suffice."""
    name = F.when(F.length("word") > LONG, F.concat(F.lit("#"), F.md5(F.col("word").cast("binary")))).otherwise(F.col("word"))
    words = materialize(words.select("word", "n", name.alias("name")), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("name").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    own = words.join(best.withColumnRenamed("a", "name"), "name", "left")
    surer = -F.col("best.col1") >= factor * F.col("n")
    out = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(surer, F.col("best.near")).alias("form"), F.when(surer, -F.col("best.col1")).alias("form_n"))
    out = materialize(out, "forms")
    discard(words)
    return out.join(roots(out.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each word's forms; each round doubles how far the roots lie ahead."""
    now = materialize(forms, "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        fresh = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(now)
        now = fresh
