"""Inverted index, weights, rankers and feedback over `documents`.

Terms are lower-cased runs of letters, two or more. Counts are the stored facts; weights are derived: idf = ln(N / df), 0 where a
term is in every document; raw weight tf * idf; normalised weight raw / norm of the document. Ties fall to the smaller document id.
Spark reads counts, weights and norms from the stored index (`sources/index.py`) and ranks by `operators/ranking.py` and
`operators/fulltext.py`; the SQL beside each query derives everything from the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import feedback, fulltext, ranking, stemming, vectors
from lexweave.operators.pairs import ratios
from lexweave.operators.vectors import VectorIndex
from lexweave.plans import topics
from lexweave.plans.dialect import STORED, add, render
from lexweave.plans.registry import register
from lexweave.sources.folders import exists, fingerprint, shared_folder
from lexweave.sources.index import Index, merged

# the facts, as common table expressions
TF = "tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM @tokens GROUP BY doc_id, term)"
DF = "df AS (SELECT term, count(*) AS df, @long(sum(tf)) AS cf FROM tf GROUP BY term)"
N = "n AS (SELECT count(*) AS n FROM documents)"
IDF = "idf AS (SELECT term, df, cf, CASE WHEN df >= n OR df <= 0 THEN 0.0 ELSE ln(n / df) END AS idf FROM df CROSS JOIN n)"
RAW = "raw AS (SELECT tf.doc_id, tf.term, tf.tf, idf.idf, tf.tf * idf.idf AS raw FROM tf JOIN idf ON tf.term = idf.term)"
NORM = "norm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id)"
INDEX = ", ".join([TF, DF, N, IDF, RAW, NORM])
# queries: the thirty commonest terms and sixty that a hash picks, dealt to thirty topics
TOPICS = (
    "common AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS place FROM (SELECT term, df FROM df WHERE length(term) >= 4 ORDER BY df DESC, term LIMIT 30)), "
    "picked AS (SELECT term FROM df WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM common) ORDER BY @hash(term), term LIMIT 60), "
    "topic AS (SELECT 1 + (row_number() OVER (ORDER BY @hash(term), term) - 1) % 30 AS query_id, term FROM common UNION ALL SELECT 1 + (row_number() OVER (ORDER BY @hash(term), term) - 1) % 30 AS query_id, term FROM picked)"
)
PAIRS = "pair AS (SELECT a.place AS query_id, x.term FROM common a JOIN common x ON x.place IN (a.place, a.place + 1) WHERE a.place < (SELECT max(place) FROM common))"
LEN = "len AS (SELECT d.doc_id, coalesce(t.len, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, @long(sum(tf)) AS len FROM tf GROUP BY doc_id) t ON t.doc_id = d.doc_id)"
DOT = "dot AS (SELECT t.query_id, r.doc_id, sum(r.raw) AS dot, count(*) AS matched FROM topic t JOIN raw r ON r.term = t.term GROUP BY t.query_id, r.doc_id)"
STORED.update({
    TF: "tf AS (SELECT doc_id, term, tf, positions[0] AS first_pos FROM stored_postings)",
    DF: "df AS (SELECT term, df, cf FROM stored_terms)",
    N: "n AS (SELECT documents AS n FROM stored_stats)",
    IDF: "idf AS (SELECT term, df, cf, idf FROM stored_terms)",
    RAW: "raw AS (SELECT p.doc_id, p.term, p.tf, t.idf, p.tf * t.idf AS raw FROM stored_postings p JOIN stored_terms t ON t.term = p.term)",
    NORM: "norm AS (SELECT doc_id, norm FROM stored_documents WHERE norm IS NOT NULL)",
    LEN: "len AS (SELECT doc_id, len FROM stored_documents)",
    DOT: "dot AS (SELECT /*+ BROADCAST(t) */ t.query_id, p.doc_id, sum(p.tf * t.idf) AS dot, count(*) AS matched FROM (SELECT topic.query_id, topic.term, idf.idf FROM topic JOIN idf ON idf.term = topic.term) t JOIN stored_postings p ON p.term = t.term GROUP BY t.query_id, p.doc_id)",
})
VECTOR = (
    "known AS (SELECT query_id, count(*) AS known FROM topic JOIN idf ON idf.term = topic.term GROUP BY query_id), "
    f"{DOT}, "
    "vector AS (SELECT d.query_id, d.doc_id, d.dot / (m.norm * sqrt(k.known)) AS score, d.matched FROM dot d JOIN norm m ON m.doc_id = d.doc_id JOIN known k ON k.query_id = d.query_id WHERE d.dot > 0)"
)
BM25 = (
    "bm25 AS (SELECT t.query_id, tf.doc_id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.len / a.avgdl))) AS score, count(*) AS matched "
    "FROM topic t JOIN tf ON tf.term = t.term JOIN df ON df.term = t.term JOIN len ON len.doc_id = tf.doc_id CROSS JOIN n CROSS JOIN (SELECT avg(len) AS avgdl FROM len) a GROUP BY t.query_id, tf.doc_id)"
)


def ranked(scores: str, k: int, more: str = "") -> str:
    return f"SELECT query_id, doc_id, round(score, 6) AS score, rank, total{more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM {scores}) WHERE rank <= {k}"


def asked(name: str, model: str, sql: str, columns: tuple[str, ...] = (), **options) -> None:
    """Registers a ranker over the topics, with its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = Index.of(spark, sf_dir)
        given = {n: {t: 1.0 / len(t) for t in terms} for n, terms in topics.topics(index).items()}
        found = ranking.rank(index, given, model, **options)
        return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "total", *columns)

    register(name, query, render(sql, 1))


def by_index(name: str, function, sql: str | None = None) -> None:
    """Registers what a function makes of the index of the folder."""
    register(name, lambda spark, sf_dir: function(Index.of(spark, sf_dir)), None if sql is None else render(sql, 1))


by_index(
    "q_postings",
    lambda index: index.postings().select("doc_id", "term", "tf", F.array_join("positions", " ").alias("places")),
    "SELECT doc_id, term, count(*) AS tf, string_agg(@text(pos), ' ' ORDER BY pos) AS places FROM @tokens GROUP BY doc_id, term",
)
add("q_document_frequencies", f"WITH {TF}, {DF} SELECT term, df, cf FROM df")
add("q_collection_frequencies", f"WITH {TF}, {DF} SELECT term, cf FROM df")
add("q_idf", f"WITH {TF}, {DF}, {N}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
add("q_raw_weights", f"WITH {INDEX} SELECT doc_id, term, round(raw, 6) AS raw FROM raw")
add("q_normalized_weights", f"WITH {INDEX} SELECT raw.doc_id, raw.term, round(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END, 6) AS w FROM raw JOIN norm ON norm.doc_id = raw.doc_id")
add("q_top_keywords", f"WITH {INDEX} SELECT doc_id, term, round(raw, 6) AS raw, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, term) AS k FROM raw WHERE raw > 0) WHERE k <= 20")
add("q_collection_stats", f"WITH {TF}, {DF}, {N}, {LEN} SELECT n.n AS documents, (SELECT count(*) FROM df) AS terms, (SELECT count(*) FROM tf) AS postings, round((SELECT avg(len) FROM len), 6) AS avgdl FROM n")
add("q_top_df_terms", f"WITH {TF}, {DF} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 10")
add("q_orphan_terms", f"WITH {TF}, {DF}, kept AS (SELECT DISTINCT term FROM tf WHERE doc_id % 2 = 0) SELECT term FROM df WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.term = df.term)")
add("q_index_stale", f"WITH {TF}, {N} SELECT n.n AS live, (SELECT count(DISTINCT doc_id) FROM tf) AS indexed, n.n <> (SELECT count(DISTINCT doc_id) FROM tf) AS stale FROM n")
add("q_matrix_cells", f"WITH {TF}, {DF}, top AS (SELECT term FROM df ORDER BY cf DESC, term LIMIT 20000) SELECT tf.doc_id, tf.term, tf.tf FROM tf JOIN top ON top.term = tf.term")
add("q_delete_reweight", f"WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM @tokens WHERE doc_id % 10 <> 3 GROUP BY doc_id, term), {DF}, n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 <> 3), {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
add("q_parse_query", f"WITH {TF}, {DF}, q AS (SELECT item_id, @each(@distinct(@words(text))) AS term FROM benchmark) SELECT q.item_id, q.term, df.df, df.term IS NULL AS unknown FROM q LEFT JOIN df ON df.term = q.term WHERE length(q.term) >= 2")
asked("q_vector_rank", "vector", f"WITH {INDEX}, {TOPICS}, {VECTOR} {ranked('vector', 20, ', matched')}", ("matched",))
asked("q_bm25", "bm25", f"WITH {TF}, {DF}, {N}, {TOPICS}, {LEN}, {BM25} {ranked('bm25', 20, ', matched')}", ("matched",))
def _together(index: Index) -> DataFrame:
    return fulltext.search(index, {n: " ".join(two) for n, two in topics.pairs(index).items()}, stems=False).select("query_id", "doc_id")


TOGETHER = "together AS (SELECT p.query_id, t.doc_id FROM pair p JOIN tf t ON t.term = p.term GROUP BY p.query_id, t.doc_id HAVING count(*) = 2)"
by_index("q_all_words_together", _together, f"WITH {TF}, {DF}, {TOPICS}, {PAIRS}, {TOGETHER} SELECT query_id, doc_id FROM together")
VIDF = (
    "q AS (SELECT t.query_id, t.term, i.idf AS w FROM topic t JOIN idf i ON i.term = t.term WHERE i.idf > 0), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM q GROUP BY query_id), "
    "vector_idf AS (SELECT q.query_id, r.doc_id, sum(q.w * r.raw) / (max(m.norm) * max(qn.qn)) AS score FROM q JOIN raw r ON r.term = q.term JOIN norm m ON m.doc_id = r.doc_id JOIN qn ON qn.query_id = q.query_id GROUP BY q.query_id, r.doc_id HAVING sum(q.w * r.raw) > 0)"
)
asked("q_vector_idf", "vector_idf", f"WITH {INDEX}, {TOPICS}, {VIDF} {ranked('vector_idf', 20)}")
asked("q_sparse_query", "sparse", f"WITH {INDEX}, {TOPICS}, q AS (SELECT query_id, term, 1.0 / length(term) AS w FROM topic), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM q GROUP BY query_id), s AS (SELECT q.query_id, r.doc_id, sum(q.w * r.raw) / (max(m.norm) * max(qn.qn)) AS score FROM q JOIN raw r ON r.term = q.term JOIN norm m ON m.doc_id = r.doc_id JOIN qn ON qn.query_id = q.query_id GROUP BY q.query_id, r.doc_id HAVING sum(q.w * r.raw) > 0) {ranked('s', 20)}")
SEM = "sem AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, @dot(q.embedding | e.embedding) / (sqrt(@dot(q.embedding | q.embedding)) * sqrt(@dot(e.embedding | e.embedding))) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id)"

def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = vectors.exact(rows.where("doc_id % 50 = 0"), rows, 10)
    totals = vectors.units(rows).count() - 1
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.lit(totals).alias("total"))


register("q_semantic_topk", _semantic, render(f"WITH {SEM} {ranked('sem', 10)}", 1))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored inverted file of the folder's vectors, made once for these very files."""
    rows = _vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/vectors-{fingerprint(rows)}"
    return VectorIndex(spark, path) if exists(spark, f"{path}/manifest") else VectorIndex.build(rows, path)


def _semantic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_index(spark, sf_dir).search(_vectors(spark, sf_dir).where("doc_id % 50 = 0"), 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


register("q_semantic_ann", _semantic_ann)


def _semantic_conj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among the documents that have both words of a pair. The queries take the pairs in turn and are compared with the
    documents of their own pair only."""
    index, rows = Index.of(spark, sf_dir), _vectors(spark, sf_dir)
    pairs = topics.pairs(index)
    if not pairs:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    allowed = fulltext.search(index, {n: " ".join(two) for n, two in pairs.items()}, stems=False).select(F.col("query_id").alias("pair"), "doc_id")
    own = rows.join(allowed, "doc_id").select("pair", "doc_id", "v")
    asked = rows.where("doc_id % 50 = 0").withColumn("pair", 1 + (F.floor(F.col("doc_id") / 50) % len(pairs)))
    found = vectors.exact_within(asked, own, 10)
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


register(
    "q_semantic_conj",
    _semantic_conj,
    render(
        f"WITH {TF}, {DF}, {TOPICS}, {PAIRS}, {TOGETHER}, {SEM}, ok AS (SELECT s.* FROM sem s JOIN together t ON t.doc_id = s.doc_id AND t.query_id = 1 + (s.query_id // 50) % (SELECT max(place) - 1 FROM common)) "
        "SELECT query_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ok) WHERE rank <= 10",
        1,
    ),
)
BY_SCORE = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r"
RRF = (
    f"parts AS (SELECT query_id, doc_id, {BY_SCORE} FROM vector UNION ALL SELECT query_id, doc_id, {BY_SCORE} FROM bm25 UNION ALL SELECT query_id // 50, doc_id, {BY_SCORE} FROM sem WHERE query_id BETWEEN 50 AND 1500), "
    "hybrid AS (SELECT query_id, doc_id, sum(1e0 / (60 + r)) AS score FROM parts WHERE r <= 60 GROUP BY query_id, doc_id)"
)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, bm25 and the nearest of a vector: topic n asks with vector 50 * n."""
    index, rows = Index.of(spark, sf_dir), _vectors(spark, sf_dir)

    def nearest() -> DataFrame:
        asked = rows.where("doc_id % 50 = 0 AND doc_id BETWEEN 50 AND 1500")
        return vectors.exact(asked, rows, ranking.DEPTH).select((F.col("query_id") / 50).cast("long").alias("query_id"), "doc_id", "score")

    given = {n: dict.fromkeys(t, 1.0) for n, t in topics.topics(index).items()}
    return ranking.best(ranking.fused(index, given, (nearest,)), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "total")


register("q_hybrid_rrf", _hybrid, render(f"WITH {INDEX}, {TOPICS}, {LEN}, {VECTOR}, {BM25}, {SEM}, {RRF} {ranked('hybrid', 20)}", 1))
PRF = (
    "fb AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM vector) WHERE r <= 5), "
    "fn AS (SELECT query_id, count(*) AS fn FROM fb GROUP BY query_id), "
    "roc AS (SELECT query_id, term, sum(w) AS w FROM (SELECT t.query_id, t.term, 1.0 / sqrt(k.known) AS w FROM topic t JOIN known k ON k.query_id = t.query_id UNION ALL "
    "SELECT fb.query_id, r.term, 0.75 * r.raw / m.norm / fn.fn AS w FROM fb JOIN raw r ON r.doc_id = fb.doc_id JOIN norm m ON m.doc_id = fb.doc_id JOIN fn ON fn.query_id = fb.query_id) GROUP BY query_id, term), "
    "cutq AS (SELECT query_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, term) AS r FROM roc WHERE w > 0) WHERE r <= 20)"
)
def _expanded(index: Index) -> DataFrame:
    found = ranking.expanded(index, {n: dict.fromkeys(t, 1.0) for n, t in topics.topics(index).items()})
    return index.spark.createDataFrame([(n, t, round(w, 6)) for n, own in found.items() for t, w in own.items()], "query_id long, term string, w double")


by_index("q_rocchio", _expanded, f"WITH {INDEX}, {TOPICS}, {VECTOR}, {PRF} SELECT query_id, term, round(w, 6) AS w FROM cutq")
EXPANDED = "pn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM cutq GROUP BY query_id), prf AS (SELECT q.query_id, r.doc_id, sum(q.w * r.raw) / (max(m.norm) * max(pn.qn)) AS score FROM cutq q JOIN raw r ON r.term = q.term JOIN norm m ON m.doc_id = r.doc_id JOIN pn ON pn.query_id = q.query_id GROUP BY q.query_id, r.doc_id HAVING sum(q.w * r.raw) > 0)"
asked("q_vector_prf", "vector_prf", f"WITH {INDEX}, {TOPICS}, {VECTOR}, {PRF}, {EXPANDED} {ranked('prf', 20)}")
JUDGED = "@hash(k.query_id * 100003 + k.doc_id) % 5"


def feedback_sql(count: int = 3) -> str:
    """Rounds of feedback, each the ranking of the vector that the one before leads to."""
    out = ["v0 AS (SELECT t.query_id, t.term, 1e0 AS w FROM topic t JOIN idf i ON i.term = t.term)", "none AS (SELECT 0 AS query_id, 0 AS doc_id, 0 AS rank WHERE false)"]
    for n in range(count):
        out.append(f"n{n} AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM v{n} GROUP BY query_id)")
        out.append(f"s{n} AS (SELECT v.query_id, r.doc_id, sum(v.w * r.raw) / (max(m.norm) * max(n.qn)) AS score FROM v{n} v JOIN raw r ON r.term = v.term JOIN norm m ON m.doc_id = r.doc_id JOIN n{n} n ON n.query_id = v.query_id GROUP BY v.query_id, r.doc_id HAVING sum(v.w * r.raw) > 0)")
        out.append(f"k{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s{n}) WHERE rank <= 20)")
        out.append(f"m{n} AS (SELECT k.query_id, k.doc_id, {JUDGED} >= 2 AS rel, count(*) OVER (PARTITION BY k.query_id, {JUDGED} >= 2) AS c FROM k{n} k WHERE {JUDGED} < 4)")
        out.append(
            f"v{n + 1} AS (SELECT query_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, term) AS i FROM (SELECT query_id, term, sum(w) AS w FROM ("
            f"SELECT query_id, term, w FROM v{n} UNION ALL SELECT m.query_id, r.term, CASE WHEN m.rel THEN 0.75e0 ELSE -0.15e0 END / m.c * r.raw / o.norm AS w FROM m{n} m JOIN raw r ON r.doc_id = m.doc_id JOIN norm o ON o.doc_id = m.doc_id) GROUP BY query_id, term) WHERE w > 0) WHERE i <= 20)"
        )
    rounds = " UNION ALL ".join(f"SELECT k.query_id, {n} AS round, k.rank, k.doc_id, round(k.score, 6) AS score, p.rank AS previous_rank FROM k{n} k LEFT JOIN {f'k{n - 1}' if n else 'none'} p ON p.query_id = k.query_id AND p.doc_id = k.doc_id" for n in range(count))
    return f"WITH {INDEX}, {TOPICS}, {', '.join(out)} {rounds}"


def _feedback(index: Index) -> DataFrame:
    """Three rounds for every topic, judged by a hash of topic and document."""
    given = {n: dict.fromkeys(t, 1.0) for n, t in topics.topics(index).items()}
    grade = F.conv(F.substring(F.md5((F.col("query_id") * 100003 + F.col("doc_id")).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    pairs = index.table("documents").select("doc_id", F.explode(F.array(*(F.lit(n).cast("long") for n in given)) if given else F.expr("cast(array() as array<bigint>)")).alias("query_id"))
    judged = pairs.where(grade < 4).select("query_id", "doc_id", (grade >= 2).alias("relevant"))
    found = feedback.rounds(index, given, judged)
    return found.select("query_id", "round", "rank", "doc_id", F.round("score", 6).alias("score"), "previous_rank")


by_index("q_feedback_rounds", _feedback, feedback_sql())
add("q_vector_diff", f"WITH {INDEX}, {TOPICS}, {VECTOR}, {PRF}, old AS (SELECT t.query_id, t.term, 1.0 / sqrt(k.known) AS w FROM topic t JOIN known k ON k.query_id = t.query_id) SELECT coalesce(o.query_id, c.query_id) AS query_id, coalesce(o.term, c.term) AS term, CASE WHEN o.term IS NULL THEN 'added' WHEN c.term IS NULL THEN 'dropped' WHEN abs(o.w - c.w) > 1e-9 THEN 'changed' ELSE 'same' END AS kind FROM old o FULL OUTER JOIN cutq c ON c.query_id = o.query_id AND c.term = o.term")
add("q_explain_score", f"WITH {INDEX}, {TOPICS}, {VECTOR}, top AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM vector) WHERE r <= 3), part AS (SELECT top.query_id, top.doc_id, t.term, r.raw / (m.norm * sqrt(k.known)) AS c, top.score FROM top JOIN topic t ON t.query_id = top.query_id JOIN raw r ON r.term = t.term AND r.doc_id = top.doc_id JOIN norm m ON m.doc_id = top.doc_id JOIN known k ON k.query_id = top.query_id) SELECT query_id, doc_id, term, round(c, 6) AS contribution, round(sum(c) OVER (PARTITION BY query_id, doc_id ORDER BY round(c, 9) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running, round(c / score, 6) AS share FROM part")
by_index(
    "q_search_page",
    lambda index: ranking.rank(index, {n: dict.fromkeys(t, 1.0) for n, t in topics.topics(index).items()}, "bm25", k=10, offset=10).select("query_id", "doc_id", "rank"),
    f"WITH {TF}, {DF}, {N}, {TOPICS}, {LEN}, {BM25} SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) WHERE rank BETWEEN 11 AND 20",
)
add("q_search_hits", f"WITH {TF}, {DF}, {N}, {TOPICS}, {LEN}, {BM25} SELECT b.query_id, b.rank, d.doc_id, d.lang, d.source, substring(d.text, 1, 80) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) b JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank <= 10")
add("q_document_detail", f"WITH {INDEX} SELECT raw.doc_id, raw.term, raw.tf, round(raw, 6) AS raw_weight, round(raw / norm, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, term) AS k FROM raw) raw JOIN norm ON norm.doc_id = raw.doc_id WHERE k <= 5 AND norm > 0")
def _websearch(stems: bool):
    def query(index: Index) -> DataFrame:
        found = fulltext.search(index, {n: topics.websearch(n, t) for n, t in topics.topics(index).items()}, stems)
        return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "matched")

    return query


# the five forms of topics.websearch, by number modulo 5: a b; a or b -c; "a b"; a -b; a b or c
FTS = (
    "word AS (SELECT * FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY @hash(term), term) AS i FROM topic) w WHERE i <= CASE WHEN query_id % 5 IN (1, 4) THEN 3 ELSE 2 END), "
    "occ AS (SELECT w.query_id, w.i, t.doc_id, t.pos, row_number() OVER (PARTITION BY w.query_id, w.i, t.doc_id ORDER BY t.pos) AS j FROM word w JOIN @tokens t ON t.term = w.term), "
    "flag AS (SELECT query_id, doc_id, bool_or(i = 1) AS a, bool_or(i = 2) AS b, bool_or(i = 3) AS c, count(DISTINCT i) AS matched, sum(CASE WHEN j <= 256 THEN 1e0 / (j * j) ELSE 0e0 END) AS alone FROM occ GROUP BY query_id, doc_id), "
    "two AS (SELECT x.query_id, x.doc_id, bool_or(y.pos = x.pos + 1) AS phrase, exp(sum(CASE WHEN x.j > 256 OR y.j > 256 OR abs(x.pos - y.pos) > 100 THEN 0e0 ELSE ln(1e0 - 0.1e0 / sqrt(1.005e0 + 0.05e0 * exp(abs(x.pos - y.pos) / 1.5e0 - 2e0))) END)) AS missed "
    "FROM occ x JOIN occ y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.i = 1 AND y.i = 2 GROUP BY x.query_id, x.doc_id), "
    "hit AS (SELECT f.*, CASE WHEN f.query_id % 5 IN (1, 4) THEN f.alone * 0.1e0 / 1.64493406685e0 / 3 ELSE 1e0 - coalesce(t.missed, 1e0) END / (ln(greatest(l.len, 1) + 1e0) / ln(2e0)) AS s FROM flag f LEFT JOIN two t ON t.query_id = f.query_id AND t.doc_id = f.doc_id JOIN len l ON l.doc_id = f.doc_id "
    "WHERE CASE f.query_id % 5 WHEN 0 THEN a AND b WHEN 1 THEN a OR (b AND NOT c) WHEN 2 THEN coalesce(t.phrase, false) WHEN 3 THEN a AND NOT b ELSE (a AND b) OR c END)"
)
by_index("q_fts_match", _websearch(False), f"WITH {TF}, {DF}, {TOPICS}, {LEN}, {FTS} SELECT query_id, doc_id, round(s / (s + 1), 6) AS score, matched FROM hit")
by_index("q_fts_stems", _websearch(True))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to fifth word of every fiftieth document, wherever they stand together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    lead = merged(docs.where("doc_id % 50 = 0")).select(F.col("doc_id").alias("query_id"), F.slice(words, 3, 3).alias("lead"))
    whole = lead.where((F.size("lead") == 3) & F.forall("lead", lambda w: F.length(w) >= 2))
    return fulltext.phrases_of(docs, whole.select("query_id", F.array_join("lead", " ").alias("phrase")), 3)


register(
    "q_fts_phrases",
    _phrases,
    render(
        "WITH t AS (SELECT * FROM @tokens), lead AS (SELECT a.doc_id AS query_id, a.term AS a, b.term AS b, c.term AS c FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.pos = 3 JOIN t c ON c.doc_id = a.doc_id AND c.pos = 4 WHERE a.pos = 2 AND a.doc_id % 50 = 0) "
        "SELECT l.query_id, x.doc_id, count(*) AS times FROM lead l JOIN t x ON x.term = l.a JOIN t y ON y.doc_id = x.doc_id AND y.pos = x.pos + 1 AND y.term = l.b JOIN t z ON z.doc_id = x.doc_id AND z.pos = x.pos + 2 AND z.term = l.c GROUP BY l.query_id, x.doc_id",
        1,
    ),
)


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document with all others. The weights of both sides are with the side that asks: the other has counts and norms."""
    index = Index.of(spark, sf_dir)
    norms = index.table("documents").where("norm > 0").select("doc_id", "norm")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 2)
    norms = norms.hint("broadcast" if index.manifest["documents"] <= 1_000_000 else "shuffle_hash")  # 30 MB at most; texts are not sorted
    of = lambda docs: merged(docs).join(norms, "doc_id").select(F.col("doc_id").alias("id"), F.lit(0).alias("more"), F.col("norm").alias("size"), words.alias("words"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = of(docs.where("doc_id % 50 = 0")).select("id", "more", "size", F.explode("words").alias("term")).groupBy("id", "more", "size", "term").agg(F.count("*").alias("tf"))
    asked = asked.join(index.table("terms").select("term", "idf"), "term").groupBy("id", "more", "size").agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf") * F.col("idf")).alias("w"))).alias("own"))
    asked = asked.select("id", "more", "size", F.col("own.term").alias("words"), F.col("own.w").alias("weights"))
    found = ratios(asked, of(docs).withColumn("weights", F.lit(None)))
    return found.select("a", "b", F.round("value", 6).alias("cosine"))


register(
    "q_cosine",
    _cosine,
    render(
        f"WITH {INDEX} SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.raw * b.raw) / (max(m.norm) * max(o.norm)), 6) AS cosine FROM raw a JOIN raw b ON a.term = b.term AND a.doc_id % 50 = 0 AND b.doc_id <> a.doc_id JOIN norm m ON m.doc_id = a.doc_id JOIN norm o ON o.doc_id = b.doc_id WHERE m.norm > 0 AND o.norm > 0 GROUP BY a.doc_id, b.doc_id",
        1,
    ),
)
add("q_known_item_topics", f"WITH {TF}, lead AS (SELECT doc_id, term, first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS i FROM tf WHERE first_pos < 100 AND length(term) >= 4) SELECT doc_id, @join(term | ' ' | first_pos) AS topic, count(*) AS terms FROM lead WHERE i <= 7 GROUP BY doc_id HAVING count(*) >= 4")
add("q_seed_documents", "SELECT url, page_id, coalesce(nullif(html, ''), '-') AS html FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i FROM pages) WHERE i = 1")
add("q_doc_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND o_orderstatus = 'O'")
add("q_list_documents", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%tion%' OR source LIKE 'src1%' ORDER BY doc_id LIMIT 20 OFFSET 40")
add("q_prefix_page", f"WITH {TF}, {DF} SELECT term, df, (SELECT count(*) FROM df WHERE term LIKE 'th%') AS total FROM df WHERE term LIKE 'th%' ORDER BY length(term), term LIMIT 20 OFFSET 20")
add("q_temp_document", f"WITH tf0 AS (SELECT doc_id, term, count(*) AS tf FROM @tokens GROUP BY doc_id, term), tf AS (SELECT * FROM tf0 UNION ALL SELECT -1, term, tf FROM tf0 WHERE doc_id = 0), {DF}, n AS (SELECT count(*) + 1 AS n FROM documents), {IDF} SELECT tf.term, tf.tf, idf.df, round(tf.tf * idf.idf, 6) AS raw FROM tf JOIN idf ON idf.term = tf.term WHERE tf.doc_id = -1")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang and word of all distinct words of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return docs.select("lang", F.explode(words).alias("word")).where(F.length("word") >= 2).distinct()


register("q_stems", lambda spark, sf_dir: stemming.stems(_words(spark, sf_dir)))
register("q_stem_conflation", lambda spark, sf_dir: stemming.conflated(stemming.stems(_words(spark, sf_dir))))
