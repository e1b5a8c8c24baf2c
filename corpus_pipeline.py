"""Corpus pipeline: documents go through toxicity, exact and near deduplication, mixing and tokenisation.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on
all that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, exact_dedup, mixing, simhash, toxicity
from loomgraph.llm.common import cut, shared_dir
from loomgraph.llm.queries import tokenizer_file


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, doesn't reject."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.resample(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("exact_dedup", exact), ("simhash", near), ("mixing", mixed), ("bpe", tokenised)]

#: SQL expresses neither trained scores nor balanced samples; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
