"""The queries of the operators in this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanbin.llm import bagminhash, bpe_stream, chatfmt, langid, lsh_forest, mixing, quality, tokencount, urltree, warc
from gleanbin.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(table(spark, sf_dir, "pages"))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op5(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatfmt.op6(table(spark, sf_dir, "conversations"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.nearest(table(spark, sf_dir, "embeddings"))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.op10(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_warc_index_merge, op2_bagminhash, op3_bpe_stream, op4_hierarchical_mixing, op5_language_id, op6_chat_format, op7_quality_cascade, op8_hash_prefix_forest, op9_trie_token_counts, op10_url_templates)}
ORACLES: dict[str, str] = {"op1_warc_index_merge": warc.ORACLE, "op4_hierarchical_mixing": mixing.ORACLE, "op6_chat_format": chatfmt.ORACLE, "op7_quality_cascade": quality.ORACLE}
