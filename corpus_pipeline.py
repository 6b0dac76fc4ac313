"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanbin.llm import bagminhash, bpe_stream, langid, mixing, quality
from gleanbin.llm.common import discard, table, written
from gleanbin.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found."""
    return langid.identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return bagminhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch that the budgets of domains, languages and sources take."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and digests of ids and decoded text."""
    return bpe_stream.digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("quality_rules", apply_quality_rules), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode)]

#: Language ID, near-dedup and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:  # what the next stage was made of
            discard(spark, before)
        before = path
    return docs
