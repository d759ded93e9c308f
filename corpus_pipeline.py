"""A training corpus from ``documents``: five stages, each an operator of ``mailfunnel.llm``, each working on all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailfunnel.llm import decontam, mixing, neardup, queries, tokenfiles, toxicity
from mailfunnel.llm.common import staged, table

#: SQL cannot express a CRF, XXH64 or the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows outside the held-out fold, does not reject."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a Jaccard similarity of 0.8 over five-word shingles; candidates by SimHash and trie self-join."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even one shortened or lengthened by a fifth of its words."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), min_words=1, wide=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target takes them, by training position."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order (a document taken twice stands twice), read back: a row per document written."""
    return tokenfiles.read_back(tokenfiles.written(docs, queries.tokenizer_path(), end=2))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("token_output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
