"""Spelling variants against every pair of words, on words full of repeated, tied and very long bigrams."""

import itertools
import random

import duckdb
import pytest

from plantwave.llm import queries, variants


def near(a, b):
    """One inserted, deleted or replaced letter apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(n, factor=10):
    near_of = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in near_of.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near_of[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "azÀÿ÷n"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choices(alphabet, k=rng.randint(4, 9))) for _ in range(500)}
    words |= {"x" * n for n in (63, 64, 65, 300, 301, 20_000, 20_001)} | {"y" * 63 + "z", "y" * 64 + "z", "y" * 64}
    n = {w: rng.choice([2, 3, 30, 300, 3000, 30_000]) for w in sorted(words)}
    rows = variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert len(rows) == len(n) and {tuple(r) for r in rows} == brute(n)


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(4)
    for _ in range(300):
        at = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weight = [rng.randint(1, 9) for _ in at]
        i, j = variants.pivots(at, weight)
        assert at[j] - at[i] >= 2
        assert weight[i] + weight[j] == min(weight[a] + weight[b] for a, b in itertools.combinations(range(len(at)), 2) if at[b] - at[a] >= 2)


def test_candidates_are_few(spark, sf):
    """Files keep words apart: candidates are a small multiple of the words, not of their pairs."""
    words = variants.word_counts(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), damage=31)
    words = words.selectExpr("word", "n", "word as name").cache()
    counts = variants.gram_counts(words)
    x, y = (variants.filed(words, counts, p) for p in (True, False))
    assert x.count() <= 8 * words.count() and x.join(y, "file").count() < 60 * words.count()


def test_words_of_odd_texts(spark):
    rows = [(1, "Abcdefg ABCDEFG abcdefg"), (1, None), (2, ""), (None, "abcdefg"), (3, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ short"), (4, "abcdefg1abcdefg"), (5, "z" * 100_000 + " " + "z" * 100_000)]
    docs = spark.createDataFrame([(*r, 9, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in variants.word_counts(docs).collect()}
    assert got == {"abcdefg": 6, "ÀÀÀÀÀÀÀ": 2, "z" * 100_000: 2}
    assert variants.variants(variants.word_counts(docs.limit(0))).count() == 0
    assert {(r["word"], r["n_near"]) for r in variants.variants(variants.word_counts(docs)).collect()} == {(w, 0) for w in got}


def test_variants_equal_sql(spark, sf):
    path = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    found = con.sql(queries.OP11_SQL)
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, path).select(*found.columns).collect()}
    assert got == set(found.fetchall())
