"""Feedback in rounds: a session's query moves with what its user marks, and every round can be replayed.

A session is a folder of rounds, each a small Parquet table, written under its own name and counted by a manifest that is renamed into place. Round 0 is the binary
query; round n starts from the vector of round n - 1, adds the marked documents by Rocchio, relevant and not, and keeps the heaviest terms. A
round's rows are its terms and weights, its ranking, and what was marked, so that replaying reads and computes nothing else. A session
belongs to one version of the index; a round on another version is refused.

Marked documents that the index doesn't have are left out. A query without a known term has no session. Repeated marks count once; a
document that is marked both ways counts both ways.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import ranking
from lexweave.sources.folders import create, exists, listed, read_text
from lexweave.sources.index import Index


class Session:
    def __init__(self, index: Index, path: str):
        self.index, self.spark, self.path = index, index.spark, path
        told = json.loads(read_text(self.spark, f"{path}/session"))
        self.terms, self.version, self.coefficients, self.most = told["terms"], told["version"], told["coefficients"], told["most"]
        if (told["index"], self.version) != (index.path, index.number):
            raise ValueError(f"the session belongs to version {self.version} of {told['index']}")

    @classmethod
    def start(cls, index: Index, path: str, terms: list[str], alpha: float = ranking.ALPHA, beta: float = ranking.BETA, gamma: float = ranking.GAMMA, most: int = ranking.TERMS, depth: int = 100) -> Session:
        """A new session with the ranking of the binary query as round 0. depth: documents that a round's ranking keeps."""
        query = {t: 1.0 for t in dict.fromkeys(terms)}
        known = set(ranking.known_terms(index, {0: query}))
        if not known:
            raise ValueError("no term of the query is in the dictionary")
        told = {"terms": [t for t in query if t in known], "index": index.path, "version": index.number, "coefficients": [alpha, beta, gamma], "most": most}
        if not create(index.spark, f"{path}/session", json.dumps(told)):
            raise ValueError(f"{path} is a session already")
        session = cls(index, path)
        session._append({t: 1.0 for t in told["terms"]}, [], [], depth)
        return session

    def rounds(self) -> int:
        """How many there are, round 0 included."""
        return sum(name.startswith("done-") for name in listed(self.spark, self.path))

    def _round(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/done-{number:04d}"))

    def mark(self, relevant: list[int], other: list[int] = (), depth: int = 100) -> int:
        """A further round; gives its number."""
        marked = ranking.document_vectors(self.index, sorted({*relevant, *other}))
        chosen = [[marked[i] for i in dict.fromkeys(ids) if marked.get(i)] for ids in (relevant, other)]
        before = self._round(self.rounds() - 1)["vector"]
        moved = ranking.heaviest(ranking.rocchio(before, *chosen, *self.coefficients), self.most)
        return self._append(moved, list(relevant), list(other), depth)

    def _append(self, vector: dict[str, float], relevant: list[int], other: list[int], depth: int) -> int:
        number = self.rounds()
        ranks = ranking.rank(self.index, {number: vector}, "sparse", depth).select(F.col("query_id").alias("round"), "rank", "doc_id", "score", "matched")
        name = f"ranking-{number:04d}"
        if not exists(self.spark, f"{self.path}/done-{number:04d}"):  # a round whose writer was lost is written again
            ranks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        told = {"vector": vector, "relevant": relevant, "other": other}
        if not create(self.spark, f"{self.path}/done-{number:04d}", json.dumps(told)):
            raise ValueError(f"round {number} is there already")
        return number

    def ranking(self, number: int) -> DataFrame:
        """rank, doc_id, score, matched of a round and the rank that each document had in the round before, null where it had none."""
        read = lambda n: self.spark.read.parquet(f"{self.path}/ranking-{n:04d}")
        now = read(number)
        if not number:
            return now.withColumn("previous_rank", F.lit(None).cast("int"))
        return now.join(read(number - 1).select("doc_id", F.col("rank").alias("previous_rank")), "doc_id", "left").select(*now.columns, "previous_rank")

    def replay(self) -> DataFrame:
        """round, term, weight, kind of every round: what was added, dropped, changed or stayed against the round before."""
        rows, before = [], {}
        for number in range(self.rounds()):
            now = self._round(number)["vector"]
            rows += [(number, t, now.get(t, 0.0), kind) for t, kind in ranking.changed(before, now).items()]
            before = now
        return self.spark.createDataFrame(rows, "round int, term string, weight double, kind string")

    def marks(self) -> DataFrame:
        """round, doc_id, relevant."""
        rows = [(n, i, yes) for n in range(self.rounds()) for yes, ids in ((True, self._round(n)["relevant"]), (False, self._round(n)["other"])) for i in ids]
        return self.spark.createDataFrame(rows, "round int, doc_id long, relevant boolean")


def rounds(index: Index, queries: ranking.Queries, judged: DataFrame, count: int = 3, depth: int = 20, alpha: float = ranking.ALPHA, beta: float = ranking.BETA, gamma: float = ranking.GAMMA) -> DataFrame:
    """The same loop for many queries at once, with known judgments instead of a user: query_id, round, rank, doc_id, score, previous_rank.

    judged: query_id, doc_id, relevant. In every round each query marks those documents of its ranking that are judged. Marks are as many as the
    queries times depth; the driver holds them and the queries, the documents' vectors are added up where they are."""
    vectors = {n: dict.fromkeys(t, 1.0) for n, t in ranking.binary(index, queries).items()}
    out, before = None, None
    for number in range(count):
        found = ranking.rank(index, vectors, "sparse", depth).select("query_id", "rank", "doc_id", "score")
        rows = [tuple(r) for r in found.collect()]  # depth rows a query
        now = index.spark.createDataFrame(rows, "query_id long, rank int, doc_id long, score double")
        told = now.select("query_id", F.lit(number).alias("round"), "rank", "doc_id", "score")
        earlier = before.select("query_id", "doc_id", F.col("rank").alias("previous_rank")) if before is not None else now.limit(0).select("query_id", "doc_id", F.col("rank").alias("previous_rank"))
        told = told.join(earlier, ["query_id", "doc_id"], "left").select("query_id", "round", "rank", "doc_id", "score", "previous_rank")
        out, before = told if out is None else out.unionByName(told), now
        if number + 1 < count:
            vectors = moved(index, vectors, [tuple(r) for r in marked(now, judged).collect()], alpha, beta, gamma)
    return out


def marked(ranks: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, doc_id, relevant of ranked documents that are judged. Judgments can be as many as documents times queries, while their size is
    taken for that of a few columns: the ranks are what is broadcast, not they."""
    asked = F.broadcast(ranks.select("query_id", "doc_id"))
    return judged.select("query_id", "doc_id", "relevant").where("relevant IS NOT NULL").join(asked, ["query_id", "doc_id"]).distinct()


def moved(index: Index, vectors: dict[int, dict[str, float]], marks: list[tuple[int, int, bool]], alpha: float, beta: float, gamma: float, most: int = ranking.TERMS) -> dict[int, dict[str, float]]:
    """The queries' vectors by Rocchio, down to their heaviest terms, from (query, document, relevant). Only those terms reach the driver."""
    ids = sorted({d for _, d, _ in marks})
    norms = {r.doc_id: r.norm for r in index.table("documents").where(F.col("doc_id").isin(ids) & (F.col("norm") > 0)).select("doc_id", "norm").collect()} if ids else {}
    marks = [m for m in marks if m[0] in vectors and m[1] in norms]
    sizes = Counter((q, yes) for q, _, yes in marks)
    parts = [(q, d, (beta if yes else -gamma) / sizes[q, yes] / norms[d]) for q, d, yes in marks]
    old = [(q, t, alpha * w) for q, own in vectors.items() for t, w in own.items()]
    if not old:
        return {q: {} for q in vectors}
    given = index.spark.createDataFrame(old, "query_id long, term string, w double")
    if parts:
        asked = F.broadcast(index.spark.createDataFrame(parts, "query_id long, doc_id long, part double"))
        rows = index.forward().where(F.col("doc_id").isin(sorted({d for _, d, _ in parts}))).select("doc_id", "term", "tf").hint("shuffle_hash").join(index.table("terms").select("term", "idf"), "term")
        given = given.unionByName(rows.join(asked, "doc_id").select("query_id", "term", (F.col("part") * F.col("tf") * F.col("idf")).alias("w")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("w", 9)), "term")
    top = given.groupBy("query_id", "term").agg(F.sum("w").alias("w")).where("w > 0").withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    out: dict[int, dict[str, float]] = {q: {} for q in vectors}
    for r in top.orderBy("query_id", "i").collect():
        out[r.query_id][r.term] = r.w
    return out
