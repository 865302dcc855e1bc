"""From raw documents to encoded training text: five stages, each written as Parquet and read again.

1. Quality rules: documents that they reject go; rejected lines leave the others.
2. Line dedup: a line that an earlier one equals or nearly equals goes; documents left without a word go.
3. Near-dedup over five-word shingles, Jaccard similarity of 0.8: of each group the document of the least id stays.
4. Mixing: each source is taken as often as its target weight asks, whole documents, repeats as rows.
5. Byte-level BPE: ids, and the digest of what they decode to.
"""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from polystore.llm.byte_bpe import encode_decode
from polystore.llm.common import use_checkpoints
from polystore.llm.line_dedup import without_repeated_lines
from polystore.llm.mixing import mixed_documents
from polystore.llm.quality_rules import clean_documents
from polystore.llm.simhash import one_of_each
from polystore.sources.runs import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, shingle=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]

#: Near-duplicates and balanced sampling aren't expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage, over what the others wrote to the checkpoint folder; what it reads stays there."""
    use_checkpoints(spark)
    folder = posixpath.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        at = posixpath.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:  # what the stage has read is no longer needed
            remove(spark, posixpath.join(folder, str(k - 1)))
    return STAGES[-1][1](spark, docs, sf_dir)
