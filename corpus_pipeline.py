"""The corpus pipeline: five stages, each over all that the one before kept. No SQL says the same: a model is trained in the first
stage and the last is byte-level BPE.

All stages take null and empty texts (neither toxic nor near copies, without secrets or words, so not in the mix), null ids (rows of their
own), very long texts whole, repeated rows (one stays at near_duplicates), different texts under one id (each is judged by itself), empty
tables (they stay empty) and further columns of any name, which they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.bpe import digest_documents
from lexweave.llm.common import documents, small_batches, written
from lexweave.llm.mixing import mix
from lexweave.llm.ngrams import one_of_each
from lexweave.llm.secrets import masked
from lexweave.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cutoff. The model comes from the labels of documents that are still here."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return digest_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
