"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``, each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.llm import decontaminate, langid, mixing, neardup, sharding
from cytomosaic.llm.common import table
from cytomosaic.session import cut

N_SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or that no language's code shortens, go.

    A null text has no letter. If no training row has a lang, nothing is learned and no document stays. Other columns stay as
    they are, also those named like columns of the operators.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.in_known_language(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingles are alike to 0.8 or more.

    Candidates are links of SimHash fingerprints by pigeonring, and for pairs beyond their reach MinHash; an exact check follows.
    Repeated rows are copies of each other: one stays. Rows that share a doc_id, or have none, take part by their text. All
    columns stay.
    """
    return neardup.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with the benchmark; those that are mostly benchmark go. Null texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix takes them, repeats as rows; null sources are one source, empty texts stay once."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, every row in one place, nulls and repeated rows included."""
    return sharding.shards(docs, N_SHARDS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
