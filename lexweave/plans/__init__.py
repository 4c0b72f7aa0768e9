"""Named queries over the tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import evaluation, memory, procedures, retrieval, texts
from lexweave.plans.registry import ORACLES, QUERIES, Query

MODULES = (retrieval, evaluation, texts, memory, procedures)


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector ranker: the twenty best documents of each topic with their scores."""
    return QUERIES["q_vector_rank"](spark, sf_dir)
