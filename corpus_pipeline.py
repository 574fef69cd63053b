"""Documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept and is written before the next one
reads it.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import chunk_recipes, matching_pack, pareto_mix, toxicity, vertical_join
from harrow.llm.queries import tokenizer_path
from harrow.plans.scratch import stage
from harrow.plans.ship import ship


def _shipped(apply):
    """The workers get the package before a stage plans Python functions."""

    @functools.wraps(apply)
    def shipped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return apply(spark, docs, sf_dir)

    return shipped


@_shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


@_shipped
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space normalised, the one with the smallest id."""
    return chunk_recipes.dedup(docs)


@_shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams at a Jaccard similarity of 0.8."""
    return vertical_join.one_of_each(docs, width=5, parts=80, whole=100)


@_shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source take them."""
    return pareto_mix.mix(docs)


@_shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return matching_pack.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
