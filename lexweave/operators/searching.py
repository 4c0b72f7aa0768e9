"""A search as a user makes it: text in, a page of hits out, whichever ranker."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import fulltext, ranking, text
from lexweave.operators.vectors import VectorIndex
from lexweave.sources.index import Index

MODELS = ("vector", "vector_idf", "vector_prf", "bm25", "fts", "semantic", "hybrid")


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W\d_]{2,}", query.lower())))


def unknown(index: Index, query: str) -> list[str]:
    """Words of a query that no document has."""
    known = ranking.known_terms(index, {0: dict.fromkeys(terms_of(query), 1.0)})
    return [t for t in terms_of(query) if t not in known]


def search(
    index: Index,
    docs: DataFrame,
    query: str,
    model: str = "vector",
    k: int = 20,
    offset: int = 0,
    where: Column | None = None,
    vectors: VectorIndex | None = None,
    vector: list[float] | None = None,
    log: str | None = None,
) -> DataFrame:
    """rank, doc_id, score, matched, total and snippet of the hits at places offset + 1 to offset + k.

    docs has doc_id, text and what `where` filters by; of rows that share an id the first text is shown. `semantic` compares `vector`, the
    query's, with `vectors`; `hybrid` fuses that list with vector and bm25, or these two alone where either is not given. A document of
    the index that docs has no longer is left out. log: a folder to which a row about the search is appended; that it fails doesn't fail
    the search. An empty query has no hits."""
    if model not in MODELS:
        raise ValueError(f"no such model: {model}")
    spark, terms = index.spark, terms_of(query)
    queries = {0: dict.fromkeys(terms, 1.0)}

    def semantic() -> DataFrame | None:
        if vectors is None or vector is None:
            return None
        asked = spark.createDataFrame([(-1, [float(x) for x in vector])], "doc_id long, v array<double>")
        return vectors.search(asked, max(offset + k, ranking.DEPTH)).select(F.lit(0).cast("long").alias("query_id"), "doc_id", "score")

    if model == "fts":
        found = fulltext.search(index, {0: query})
    elif model == "semantic":
        if (found := semantic()) is None:
            raise ValueError("semantic search needs vectors and the query's vector")
        found = found.withColumn("matched", F.lit(0).cast("long"))
    elif model == "hybrid":
        found = ranking.fused(index, queries, (semantic,))
    else:
        found = ranking.scored(index, queries, model)
    allowed = (docs if where is None else docs.where(where)).select("doc_id").distinct()
    page = ranking.best(found.join(allowed, "doc_id", "left_semi"), k, offset)
    hits = [tuple(r) for r in page.select("rank", "doc_id", "score", "matched", "total").orderBy("rank").collect()]  # k rows
    shown = docs.where(F.col("doc_id").isin([h[1] for h in hits])).groupBy("doc_id").agg(F.min("text").alias("text"))
    shown = text.per_row(shown, ["text"], lambda t: text.snippet(t, set(terms))[0], "string", "doc_id").withColumnRenamed("out", "snippet")
    out = spark.createDataFrame(hits, "rank int, doc_id long, score double, matched long, total long").join(shown, "doc_id").select("rank", "doc_id", "score", "matched", "total", "snippet").orderBy("rank")
    if log is not None:
        try:
            row = [(query, model, k, offset, where is not None, hits[0][4] if hits else 0, len(hits), index.number)]
            told = spark.createDataFrame(row, "query string, model string, k int, offset int, filtered boolean, total long, returned int, version int")
            told.withColumn("at", F.current_timestamp()).write.mode("append").parquet(log)
        except Exception as e:  # the log is best effort
            print(f"search not logged: {e}")
    return out
