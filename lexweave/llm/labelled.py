"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bucket_of

#: Rows whose id falls here are held out: classifiers never see their labels.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id) -> F.Column:
    return F.coalesce(bucket_of(doc_id, FOLDS) == HELD_OUT, F.lit(False))


#: Longest text of an example, in bytes.
LARGEST = 1 << 16


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, y of at most `most` labelled documents of each class outside the held-out fold, those with the least hash of
    their id, and how many labels of each class there are. Rows with a null or other label, or a null id, are no examples; an id with
    both labels counts as 0 and 1. The sample's size is bounded by 2 * most ids, so its ids are broadcast, and by `LARGEST` bytes a text:
    longer ones are no examples."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LARGEST), counts
