"""The pipeline's stages, each on its own input."""

import brute
import pytest

import corpus_pipeline
from plantwave.llm import quality


@pytest.fixture(scope="module")
def path(sf):
    return sf.replace("0.001", "0.01")


def test_stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    known = steps["language ID"](spark, docs, path)
    assert known.columns == columns and known.count() >= 0.98 * docs.count()
    good = steps["quality rules"](spark, known, path)
    failed = {r["doc_id"] for r in quality.judge(known, None).where("base_failed").collect()}
    assert good.columns == columns and not failed & {r["doc_id"] for r in good.select("doc_id").collect()}
    one = steps["n-gram Jaccard join"](spark, good, path)
    want = brute.components([tuple(r) for r in good.select("doc_id", "text").collect()], 5, 80, 100)
    assert one.columns == columns and sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    packed = steps["best-fit packing"](spark, one, path)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in one.select("doc_id").collect()}


def test_stages_of_odd_rows(spark, path):
    """Null, empty and very long texts, repeated rows and ids, ties, rows without an id, further columns with the operators' names."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = docs.join(quality.judge(docs, None).where("kept").select("doc_id"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    a, b, c = (r["text"] for r in good)
    texts = [(None, a), (1, None), (2, ""), (3, " \n "), (4, a), (4, a), (5, a), (6, b), (6, c), (7, b + " again"), (8, " ".join([a, b, c]) * 40), (9, "12 34"), (None, None), (10, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 0.5, i) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, score double, component_id long")
    odd = odd.unionByName(docs, allowMissingColumns=True)
    columns, steps = odd.columns, dict(corpus_pipeline.STAGES)
    known = steps["language ID"](spark, odd, path)
    assert known.columns == columns and not known.where("text is null or trim(text) = '' or doc_id = 9 and n is not null").count()
    assert {4, 5, 6, 7, 8} <= {r["doc_id"] for r in known.where("n is not null").collect()}
    rich = steps["quality rules"](spark, known, path)
    assert rich.columns == columns and rich.where("n is not null and doc_id = 4").count() == 2
    one = steps["n-gram Jaccard join"](spark, rich, path)
    assert one.columns == columns and one.groupBy("doc_id").count().where("doc_id is not null and count > 1").count() == 0
    want = brute.components([(r["doc_id"], r["text"]) for r in rich.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()], 5, 80, 100)
    assert {r["doc_id"] for r in one.where("doc_id > 10").collect()} <= want.keys() and one.where("doc_id is null").count() == rich.where("doc_id is null").count()
    packed = steps["best-fit packing"](spark, one, path)
    assert packed.groupBy("doc_id", "piece").count().where("count > 1 and doc_id is not null").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in one.select("doc_id").distinct().collect()}


def test_empty_corpus(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
