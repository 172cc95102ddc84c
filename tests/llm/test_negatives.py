"""Hard negatives: residue arithmetic against exact integers, lists against every pair of rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwave.llm import negatives, queries

ROW = "vec_id long, embedding array<double>, label int, n int, score double"


def brute(rows, asked, positives=5, count=3):
    """rows: (id, vector of integers, label) in table order."""
    out = []
    for i, (anchor, v, label) in enumerate(rows):
        if not asked(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), other, j, own) for j, (other, w, own) in enumerate(rows) if j != i)
        for score, positive, _, own in [s for s in scored if s[3] == label][:positives]:
            fits = [(n, -s) for s, n, _, o in scored if o != label and -50 * score <= -100 * s <= -95 * score]
            out += [(anchor, positive, k + 1, n, -score, s) for k, (n, s) in enumerate(fits[:count])]
    return sorted(out)


@pytest.mark.parametrize(("dim", "size"), [(3, 10), (64, 300), (200, 2**20), (130, 2**27)])
def test_residues_give_exact_products(dim, size):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-size, size, (40, dim)), rng.integers(-size, size, (30, dim))
    a[0], b[0] = -size, size
    primes = negatives.moduli(dim * size * size)
    assert np.prod([float(p) for p in primes]) > 2.0 * dim * size * size and negatives.DEPTH * (max(primes) // 2) ** 2 < 2**24
    assert (negatives.Residues(a, primes).products(negatives.Residues(b, primes)) == a @ b.T).all()


@pytest.mark.parametrize("small", [False, True])
def test_lists_equal_brute_force(spark, monkeypatch, small):
    """Ties, repeated rows and ids, a label with most of the rows; small blocks make many parts, stripes and tiles."""
    if small:
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 64)
        monkeypatch.setattr(negatives, "STRIPE_ROWS", 40)
        monkeypatch.setattr(negatives, "TILE", (3, 16))
    rng = random.Random(3)
    rows = [(i, [rng.randint(-3, 6) for _ in range(4)], rng.choice([0, 0, 0, 0, 1, 2, 900])) for i in range(200)]
    rows += [(200 + i, [1, 2, 3, 4], i % 2) for i in range(40)] + [(50, [5, 5, 5, 5], 0), (50, [5, 5, 5, 5], 1)]
    df = spark.createDataFrame([(i, [x / 256 for x in map(float, v)], label, 7, 0.5) for i, v, label in rows], ROW).coalesce(1)
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.7, 0.0], 2), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [None, 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 0.0], 1), (8, [1.0], 1), (9, [], 1), (10, [1e300, 1.0], 1), (11, [0.5, 0.0], 2), (12, [0.49, 0.0], 2), (13, [0.96, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, 0.0) for r in rows], ROW)
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 2, 65536, 179 * 256), (0, 1, 2, 11, 65536, 128 * 256)]
    assert negatives.hard_negatives(df.limit(0), F.col("label"), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("label"), F.lit(None).cast("boolean")).count() == 0
    negative = spark.createDataFrame([(0, [1.0], 1, 1, 0.0), (1, [-1.0], 1, 1, 0.0), (2, [-0.7], 2, 1, 0.0)], ROW)
    assert negatives.hard_negatives(negative, F.col("label"), F.col("vec_id") == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [2**29 - i, i], i % 2) for i in range(30)]
    df = spark.createDataFrame([(i, [float(x) for x in v], label, 1, 0.0) for i, v, label in rows], ROW)
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") == 4, high=100, scale=1.0)
    want = sorted((-((2**29 - 4) * v[0] + 4 * v[1]), i) for i, v, label in rows if label == 0 and i != 4)[:5]
    assert {(r["positive_id"], -r["positive_score"]) for r in got.collect()} <= {(i, s) for s, i in want} and got.count() > 0


def test_negatives_equal_sql(spark, sf):
    path = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    found = con.sql(queries.OP12_SQL)
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, path).select(*found.columns).collect())) == sorted(found.fetchall())
