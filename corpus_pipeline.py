"""A corpus in four stages: language, quality, near duplicates, packing.

Each stage reads what the one before it kept. The first three return the columns of documents, the last the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantwave.llm import jaccard, langid, packing, quality
from plantwave.llm.common import discard, materialize
from plantwave.llm.queries import TOKENIZER

#: A document whose language is less sure than this is rejected, as are those without a letter.
LEAST_SCORE = 0.35
#: No SQL expresses a trained network; the stages are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: null and letterless texts and unsure ones go."""
    return langid.keep_languages(docs, langid.fit(docs), LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose words mostly lie in content lines."""
    return quality.keep_content(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group linked by five-word shingles at 0.8; rows without an id stay."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed in sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
