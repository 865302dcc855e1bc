"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from polystore.llm.byte_bpe import encode_decode
from polystore.llm.common import documents
from polystore.llm.imatch import fingerprint_documents
from polystore.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from polystore.llm.line_dedup import line_dedup
from polystore.llm.mixing import mix
from polystore.llm.pii import find_pii
from polystore.llm.quality_rules import ORACLE as QUALITY_SQL
from polystore.llm.quality_rules import quality_rules
from polystore.llm.simhash import near_duplicates
from polystore.llm.substring_dedup import repeated_passages
from polystore.llm.token_counts import token_counts
from polystore.llm.toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("copies", "source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_imatch, op3_simhash, op4_toxicity, op5_substring_dedup, op6_line_dedup, op7_byte_bpe, op8_pii, op9_mixing, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op10_quality_rules": QUALITY_SQL}
