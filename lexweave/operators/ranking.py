"""Rankers over the stored index, for many queries at once.

Queries are a dict from number to weighted terms, given by a user and so few; their terms and what the dictionary says of them, a row
each, are broadcast, and named literally, so that the sorted postings are pruned to them. One scan of the postings then serves all queries: a document's parts of a
query's score are summed by (query, document), norms and lengths come by document. The best `k` are chosen by a window whose limit is
applied before the rows of a query meet; ties fall to the smaller id. Scores are compared rounded to nine places.

`vector` is the cosine with a binary query, `vector_idf` with a query weighted by idf, `sparse` with the given weights; `bm25` has k1 1.2
and b 0.75; `vector_prf` expands the binary query by Rocchio from its five best documents. Terms that no document has count for
nothing; where no term is known a query has no rows. An empty index gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.sources.index import Index

K1, B = 1.2, 0.75
#: Feedback: documents taken as relevant, weights of the query, of relevant and of other documents, and terms kept.
FEEDBACK, ALPHA, BETA, GAMMA, TERMS = 5, 1.0, 0.75, 0.15, 20
#: Reciprocal rank fusion: the constant, and how deep a list counts.
RRF, DEPTH = 60, 60

Queries = Mapping[int, Mapping[str, float]]
SCORED = "query_id long, doc_id long, score double, matched long"


def known_terms(index: Index, queries: Queries) -> dict[str, tuple[int, float]]:
    """df and idf of the queries' terms that the dictionary has: a row a term."""
    wanted = sorted({t for q in queries.values() for t in q})
    return {r.term: (r.df, r.idf) for r in index.table("terms").where(F.col("term").isin(wanted)).select("term", "df", "idf").collect()} if wanted else {}


def weighted(index: Index, queries: Queries, model: str) -> DataFrame | None:
    """query_id, term, weight, idf, df and norm of the query, by the model's rule; None where no term is known."""
    known, rows = known_terms(index, queries), []
    for number, terms in queries.items():
        own = {t: 1.0 if model in ("vector", "bm25") else known[t][1] if model == "vector_idf" else w for t, w in terms.items() if t in known}
        own = {t: w for t, w in own.items() if w}
        norm = math.sqrt(sum(w * w for w in own.values()))
        rows += [(number, t, float(w), known[t][1], known[t][0], norm) for t, w in own.items()]
    return index.spark.createDataFrame(rows, "query_id long, term string, weight double, idf double, df long, norm double") if rows else None


def scored(index: Index, queries: Queries, model: str = "vector") -> DataFrame:
    """query_id, doc_id, score, matched of all documents that a query finds."""
    if model == "vector_prf":
        return scored(index, expanded(index, queries), "sparse")
    if model not in ("vector", "vector_idf", "sparse", "bm25"):
        raise ValueError(f"no such model: {model}")
    asked = weighted(index, queries, model)
    if asked is None:
        return index.spark.createDataFrame([], SCORED)
    hits = index.postings({t for q in queries.values() for t in q}).join(F.broadcast(asked), "term")
    by = hits.groupBy("query_id", "doc_id")
    if model == "bm25":
        stats = index.manifest
        part = F.ln(1 + (F.lit(stats["documents"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1)
        return by.agg(F.sum(part / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(stats["avgdl"] or 1.0)))).alias("score"), F.count("*").alias("matched"))
    sums = by.agg(F.sum(F.col("weight") * F.col("tf") * F.col("idf")).alias("dot"), F.count("*").alias("matched"), F.first("norm").alias("query_norm"))
    sums = sums.where("dot > 0").join(index.table("documents").select("doc_id", "norm"), "doc_id")
    return sums.select("query_id", "doc_id", (F.col("dot") / (F.col("norm") * F.col("query_norm"))).alias("score"), "matched")


def best(scores: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The rows from place offset + 1 on, k of them, of each query, with their rank and how many the query found in all."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + k).where(F.col("rank") > offset)
    totals = scores.groupBy("query_id").agg(F.count("*").alias("total"))  # a row for each query
    return top.join(F.broadcast(totals), "query_id")


def rank(index: Index, queries: Queries, model: str = "vector", k: int = 20, offset: int = 0, only: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, matched, rank, total. only: the ids (doc_id) that filters leave."""
    found = fused(index, queries) if model == "hybrid" else scored(index, queries, model)
    return best(found if only is None else found.join(only.select("doc_id").distinct(), "doc_id", "left_semi"), k, offset)


def fusion(*lists: DataFrame, constant: int = RRF, depth: int = DEPTH) -> DataFrame:
    """query_id, doc_id, score and matched: the sum of 1 / (constant + rank) over ranked lists (query_id, doc_id, score), each down to a
    depth. matched: lists that have the document."""
    parts = [best(x.select("query_id", "doc_id", "score"), depth).select("query_id", "doc_id", "rank") for x in lists]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), F.count("*").alias("matched"))


def fused(index: Index, queries: Queries, more: tuple = ()) -> DataFrame:
    """Fusion of vector, bm25 and further lists: functions that give (query_id, doc_id, score), or None where a list has nothing to
    offer, such as a semantic list without vectors; it is left out then, as is one that can't be planned because what it reads is missing."""
    from pyspark.errors import AnalysisException

    lists = [scored(index, queries, "vector"), scored(index, queries, "bm25")]
    for give in more:
        try:
            found = give()
        except AnalysisException:
            continue
        if found is not None:
            lists.append(found)
    return fusion(*lists)


# ---- feedback


def document_vectors(index: Index, ids: list[int]) -> dict[int, dict[str, float]]:
    """Normalised weights of some documents, which a user names or a ranker's few best: a row for each of their terms."""
    if not ids:
        return {}
    rows = index.forward().where(F.col("doc_id").isin(ids)).join(index.table("terms").select("term", "idf"), "term")
    rows = rows.join(index.table("documents").where(F.col("doc_id").isin(ids)).select("doc_id", "norm"), "doc_id").where("norm > 0")
    out: dict[int, dict[str, float]] = {i: {} for i in ids}
    for r in rows.select("doc_id", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w")).where("w <> 0").collect():
        out[r.doc_id][r.term] = r.w
    return out


def rocchio(query: Mapping[str, float], relevant: list, other: list, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> dict[str, float]:
    """alpha * query + beta * mean(relevant) - gamma * mean(other); negative weights stay."""
    out = {t: alpha * w for t, w in query.items()}
    for vectors, scale in ((relevant, beta), (other, -gamma)):
        for v in vectors if scale else ():
            for t, w in v.items():
                out[t] = out.get(t, 0.0) + scale / len(vectors) * w
    return out


def heaviest(vector: Mapping[str, float], most: int = TERMS, negative: bool = False) -> dict[str, float]:
    """The heaviest terms, negative ones only if asked; ties, to nine places, fall to the smaller term."""
    kept = [(t, w) for t, w in vector.items() if w > 0 or negative and w < 0]
    return dict(sorted(kept, key=lambda x: (-round(abs(x[1]), 9), x[0]))[: max(0, most)])


def changed(before: Mapping[str, float], after: Mapping[str, float]) -> dict[str, str]:
    """Each term of either vector: added, dropped, changed or same."""
    kind = lambda t: "added" if t not in before else "dropped" if t not in after else "changed" if abs(before[t] - after[t]) > 1e-9 else "same"
    return {t: kind(t) for t in {**before, **after}}


def binary(index: Index, queries: Queries) -> dict[int, dict[str, float]]:
    """The queries' known terms, of norm 1."""
    known = known_terms(index, queries)
    out = {}
    for number, terms in queries.items():
        own = [t for t in terms if t in known]
        out[number] = {t: 1 / math.sqrt(len(own)) for t in own}
    return out


def expanded(index: Index, queries: Queries, feedback: int = FEEDBACK) -> dict[int, dict[str, float]]:
    """The queries moved towards their best documents."""
    top = best(scored(index, queries, "vector"), feedback).select("query_id", "doc_id").collect()  # `feedback` rows a query
    vectors = document_vectors(index, sorted({r.doc_id for r in top}))
    return {number: heaviest(rocchio(own, [vectors[r.doc_id] for r in top if r.query_id == number], [], 1.0, BETA, 0.0)) for number, own in binary(index, queries).items()}
