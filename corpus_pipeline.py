"""A corpus pipeline: quality rules, n-gram Jaccard join, mixing of sources, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next one's docs. The first three return the columns of
documents: the rules' rejections go, one document of each class of near-duplicates stays, and sources
are repeated as the mixture asks (no document is lost) and written in the order of its permutation. The last
returns the digest of every encoded row.

Defined cases: a null or short text fails the base rule and goes; null sources and languages count as values of
their own; a doc_id on several texts keeps one row of each class; equal rows are one class, of which one stays; an empty
table gives no row; texts of any length pass whole; other columns go through the first three stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeline.llm import bpe, mixing, ngram_join, quality
from treeline.plans.shared import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, public_tokenizers.path(bpe.TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("temperature mixing", mixture),
    ("BPE encoding", encoding),
]
#: The mixture's seeded permutation and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "-"))
    return docs
