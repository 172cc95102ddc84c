"""Near duplicates by bottom-k sketches against every pair that shares a shingle."""

import random

import brute
import duckdb
import numpy as np
import pytest

from plantwave.llm import bottomk, queries

DOC = "doc_id long, text string, n int, value string, head long"


def family(seed=0, groups=12):
    """Texts of many lengths with chains of edits, copies, a passage that most of them share, and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(120)]
    out = []
    for g in range(groups):
        text = [word() for _ in range(rng.choice([2, 5, 30, 60, 75, 90, 400]))]
        if g % 3 == 0:
            text = passage + text
        for _ in range(rng.randint(1, 9)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "num", "block", "heavy"), [(3, 85, 256, 1 << 16), (5, 80, 2, 4), (3, 85, 3, 1)])
def test_components_equal_brute_force(spark, monkeypatch, words, num, block, heavy):
    monkeypatch.setattr(bottomk, "BLOCK", block)
    monkeypatch.setattr(bottomk, "HEAVY", heavy)
    monkeypatch.setattr(bottomk, "MEMBERS", block)
    texts = family(words) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a b"), (1006, "x " * 20_000)]
    want = brute.components(texts, words, num, 100)
    df = spark.createDataFrame([(*t, 1, "v", 3) for t in [*texts, (None, "a b"), (None, None), texts[3]]], DOC)
    got = bottomk.near_duplicates(df, words, num, 100).collect()
    assert len(got) == len(texts) + 3 and len({c for _, c in want.values()}) < len(texts) - 10
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert bottomk.near_duplicates(df.limit(0), words, num, 100).count() == 0


def test_estimates_hold_their_chance():
    """Similar sets share as many retained values as `needed` says, and the union sketch passes them."""
    least, rng = np.array([bottomk.needed(i, 85, 100) for i in range(65)]), np.random.default_rng(5)
    for _ in range(3000):
        union = int(rng.integers(70, 900))
        both = -(-85 * union // 100)
        h = rng.permutation(np.unique(rng.integers(0, 2**63, 2 * union).astype(np.uint64)))[:union]
        cut = both + (union - both) // 2
        x, y = np.sort(h[:cut])[:64], np.sort(np.concatenate([h[:both], h[cut:]]))[:64]
        assert len(np.intersect1d(x, y)) >= least[64]
        assert bottomk.passing([x], [y], np.array([cut]), np.array([both + union - cut]), 64, 85, 100, least).all()
        values, counts = np.unique(np.concatenate([x, y]), return_counts=True)
        assert [int(v[0]) for v in bottomk.estimates(bottomk.table([x], 64, 0), bottomk.table([y], 64, 1), 64)] == [int((counts[:64] == 2).sum()), min(64, len(values))]
    apart = np.arange(64, dtype=np.uint64), np.arange(40, 104, dtype=np.uint64)
    assert not bottomk.passing([apart[0]], [apart[1]], np.array([99]), np.array([99]), 64, 85, 100, least).any()


def test_prefixes_leave_what_must_be_shared():
    sizes = bottomk.prefix_sizes(64, 85, 100)
    assert sizes[0] == 0 and sizes[1] == 1 and sizes[20] == 20 - 17 + 1 and sizes[64] == 64 - bottomk.needed(64, 85, 100) + 1


def test_ids_with_several_texts_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, b), (3, a), (7, b), (9, "else entirely different words here now")]
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(5, 3), (3, 3), (7, 3), (9, 9)}


def test_dedup_equals_sql(spark, sf):
    path = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    found = con.sql(queries.OP13_SQL)
    assert sorted(map(tuple, queries.op13_minhash_near_dedup(spark, path).select(*found.columns).collect())) == sorted(found.fetchall())
