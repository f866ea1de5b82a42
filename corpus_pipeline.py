"""The training-data pipeline over ``documents``.

Each stage takes the documents that its predecessor kept and is stored before the next one reads
it. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostwin.llm import langid, mixing, packing, secrets, simhash
from hostwin.llm.queries import tokenizer_file
from hostwin.session import pin, remove, scratch_path, scratch_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters or without clear language go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word Jaccard similarity of 0.8 or more: that with the smallest id."""
    return simhash.keep_one_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and lengths counted anew."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, some more than once, so that tokens have evened-out source, language and topic shares."""
    return mixing.repeat_mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, neighbours on the curve together."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False).withColumnRenamed(
        "id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan),
          ("mixture", mixture), ("packing", packed)]

#: No SQL states the language model, the tests for randomness or the curve; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns.

    What a stage stores on its way is removed when its result is stored, and that when the next one is.
    """
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            docs = pin(stage(spark, docs, sf_dir), path)
        if former:
            remove(spark, former)
        former = path
    return docs
