"""Retrieval evaluation: judgments, metrics as window expressions, pooling, tests of significance.

Topics are thirty groups of three terms; two runs rank their documents by tf and by BM25-like saturation. A document's grade, 0 to 3,
comes from a hash of topic and document, so that judgments are fixed and independent of any ranking; a fifth is unjudged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import ranking, significance
from lexweave.plans import topics
from lexweave.plans.dialect import add, render
from lexweave.plans.registry import register
from lexweave.plans.retrieval import BM25, DF, EXPANDED, INDEX, LEN, PRF, TF, TOPICS, VECTOR, VIDF
from lexweave.sources.folders import checkpointed
from lexweave.sources.index import Index

RUNS = (
    "run AS (SELECT name, query_id, doc_id, score, row_number() OVER (PARTITION BY name, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM "
    "(SELECT 'vector' AS name, query_id, doc_id, score FROM vector UNION ALL SELECT 'bm25' AS name, query_id, doc_id, score FROM bm25)), run100 AS (SELECT * FROM run WHERE rank <= 100)"
)
QREL = (
    "graded AS (SELECT DISTINCT query_id, doc_id, @hash(query_id * 100003 + doc_id) % 5 AS h FROM run), "
    "qrel AS (SELECT query_id, doc_id, h < 4 AND h >= 2 AS is_rel, h < 2 AS is_nonrel, CASE WHEN h < 4 THEN h ELSE 0 END AS gain FROM graded), "
    "r AS (SELECT query_id, count(CASE WHEN is_rel THEN 1 END) AS r, count(CASE WHEN is_nonrel THEN 1 END) AS nr FROM qrel GROUP BY query_id), "
    "j AS (SELECT run100.name, run100.query_id, run100.rank, run100.doc_id, coalesce(is_rel, false) AS rel, coalesce(is_nonrel, false) AS nonrel, coalesce(gain, 0) AS gain, r.r, r.nr FROM run100 JOIN r ON r.query_id = run100.query_id LEFT JOIN qrel ON qrel.query_id = run100.query_id AND qrel.doc_id = run100.doc_id WHERE r.r > 0)"
)
BASE = ", ".join([INDEX, TOPICS, LEN, VECTOR, BM25, RUNS, QREL])
REL = "CASE WHEN rel THEN 1 ELSE 0 END"
HITS = f"h AS (SELECT *, @long(sum({REL}) OVER (PARTITION BY name, query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS hits, @long(sum(CASE WHEN nonrel THEN 1 ELSE 0 END) OVER (PARTITION BY name, query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bad FROM j)"


def metric(name: str, expression: str, source: str = "h", more: str = "") -> None:
    add(name, f"WITH {BASE}, {HITS}{more} SELECT name, query_id, round({expression}, 6) AS value FROM {source} GROUP BY name, query_id")


AP = "sum(CASE WHEN rel THEN hits / CAST(rank AS DOUBLE) ELSE 0 END) / max(r)"
add("q_run_results", f"WITH {BASE} SELECT name, query_id, doc_id, rank FROM run100")
add("q_judgments", f"WITH {BASE} SELECT query_id, doc_id, is_rel, is_nonrel, gain FROM qrel")
metric("q_average_precision", AP)
metric("q_r_precision", f"sum(CASE WHEN rank <= r THEN {REL} ELSE 0 END) / CAST(max(r) AS DOUBLE)")
metric("q_mrr", "coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0e0)")
add("q_set_measures", f"WITH {BASE} SELECT name, query_id, round(p, 6) AS p, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM (SELECT name, query_id, sum({REL}) / CAST(count(*) AS DOUBLE) AS p, sum({REL}) / CAST(max(r) AS DOUBLE) AS rc FROM j GROUP BY name, query_id)")
add("q_precision_at_k", f"WITH {BASE}, k AS (SELECT @each(@range(1 | 20)) AS k) SELECT name, query_id, k.k AS k, round(sum(CASE WHEN rank <= k.k THEN {REL} ELSE 0 END) / CAST(k.k AS DOUBLE), 6) AS value FROM j CROSS JOIN k WHERE k.k IN (1, 5, 10, 20) GROUP BY name, query_id, k.k")
add("q_p_at_k_curve", f"WITH {BASE}, k AS (SELECT @each(@range(1 | 30)) AS k), p AS (SELECT name, query_id, k.k AS k, sum(CASE WHEN rank <= k.k THEN {REL} ELSE 0 END) / CAST(k.k AS DOUBLE) AS value FROM j CROSS JOIN k WHERE k.k IN (1, 3, 5, 10, 15, 20, 30) GROUP BY name, query_id, k.k) SELECT name, k, round(avg(value), 6) AS value FROM p GROUP BY name, k")
add("q_pr_curve", f"WITH {BASE}, {HITS} SELECT name, query_id, rank, round(hits / CAST(r AS DOUBLE), 6) AS recall, round(hits / CAST(rank AS DOUBLE), 6) AS p FROM h WHERE rel")
LEVELS = "lv AS (SELECT @each(@range(0 | 10)) AS level)"
BEST = "b AS (SELECT *, max(CASE WHEN rel THEN hits / CAST(rank AS DOUBLE) END) OVER (PARTITION BY name, query_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM h)"


def iprec(need: str) -> str:
    return f"WITH {BASE}, {HITS}, {LEVELS}, {BEST}, t AS (SELECT DISTINCT name, query_id, r FROM j), c AS (SELECT t.name, t.query_id, lv.level, t.r, {need} AS need FROM t CROSS JOIN lv), x AS (SELECT c.name, c.query_id, c.level, max(CASE WHEN b.hits >= c.need THEN b.best END) AS p FROM c LEFT JOIN b ON b.name = c.name AND b.query_id = c.query_id GROUP BY c.name, c.query_id, c.level)"


CEIL = "ceil(lv.level * t.r / 10e0 - 1e-9)"
add("q_iprec11", iprec(CEIL) + " SELECT name, level, round(avg(coalesce(p, 0)), 6) AS p FROM x GROUP BY name, level")
add("q_iprec11_trec", iprec("floor(lv.level * t.r / 10e0 + 0.5e0)") + " SELECT name, level, round(avg(coalesce(p, 0)), 6) AS p FROM x GROUP BY name, level")
add("q_iprec11_nz", iprec(CEIL) + " SELECT name, level, round(avg(p), 6) AS p, count(p) AS support FROM x GROUP BY name, level")
DCG = "(pow(2e0, gain) - 1) / (ln(1e0 + rank) / ln(2e0))"
IDEAL = "ideal AS (SELECT query_id, sum((pow(2e0, gain) - 1) / (ln(1e0 + i) / ln(2e0))) AS ideal FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS i FROM qrel) WHERE i <= 100 GROUP BY query_id)"
add("q_ndcg", f"WITH {BASE}, {IDEAL} SELECT j.name, j.query_id, round(CASE WHEN max(ideal) > 0 THEN sum({DCG}) / max(ideal) ELSE 0 END, 6) AS value FROM j JOIN ideal ON ideal.query_id = j.query_id GROUP BY j.name, j.query_id")
BPREF = "sum(CASE WHEN rel THEN CASE WHEN least(r, nr) = 0 THEN 1e0 ELSE 1e0 - least(bad, least(r, nr)) / CAST(least(r, nr) AS DOUBLE) END ELSE 0 END) / max(r)"
metric("q_bpref", BPREF)
metric("q_bpref_romip", "sum(CASE WHEN rel THEN 1e0 - least(bad, r + 10) / CAST(r + 10 AS DOUBLE) ELSE 0 END) / max(r)")
ERRP = ", g AS (SELECT *, (pow(2e0, gain) - 1) / 8e0 AS p FROM j), e AS (SELECT *, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY name, query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS look FROM g)"
metric("q_err", "sum(look * p / rank)", "e", ERRP)
PF = ", g AS (SELECT *, CASE WHEN gain > 0 THEN 0.5e0 * pow(2e0, gain - 3) ELSE 0e0 END AS p FROM j), e AS (SELECT *, exp(coalesce(sum(ln((1 - p) * 0.85e0)) OVER (PARTITION BY name, query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS look FROM g)"
metric("q_pfound", "sum(look * p)", "e", PF)
SCORES = f"sc AS (SELECT name, query_id, {AP} AS ap, {BPREF} AS bpref, sum(CASE WHEN rank <= 10 THEN {REL} ELSE 0 END) / 10e0 AS p10, coalesce(1e0 / min(CASE WHEN rel THEN rank END), 0e0) AS rr, count(*) AS num_ret, @long(sum({REL})) AS num_rel_ret, @long(max(r)) AS num_rel, @long(sum(CASE WHEN NOT rel AND NOT nonrel THEN 1 ELSE 0 END)) AS num_unjudged FROM h GROUP BY name, query_id)"
add("q_topic_scores", f"WITH {BASE}, {HITS}, {SCORES} SELECT name, query_id, round(ap, 6) AS ap, round(bpref, 6) AS bpref, round(p10, 6) AS p10, round(rr, 6) AS rr, num_ret, num_rel_ret, num_rel, num_unjudged FROM sc")
add("q_macro_average", f"WITH {BASE}, {HITS}, {SCORES} SELECT name, round(avg(ap), 6) AS map, round(avg(bpref), 6) AS bpref, round(avg(p10), 6) AS p10, round(avg(rr), 6) AS mrr, @long(sum(num_ret)) AS num_ret, @long(sum(num_rel_ret)) AS num_rel_ret, round(avg(num_rel), 6) AS num_rel, @long(sum(num_unjudged)) AS num_unjudged FROM sc GROUP BY name")
add("q_run_leaderboard", f"WITH {BASE}, {HITS}, {SCORES} SELECT name, round(avg(ap), 6) AS map, row_number() OVER (ORDER BY round(avg(ap), 9) DESC, name) AS place FROM sc GROUP BY name")
PAIRED = "d AS (SELECT a.query_id, a.ap - b.ap AS d FROM sc a JOIN sc b ON a.query_id = b.query_id AND a.name = 'bm25' AND b.name = 'vector')"
add("q_compare_runs", f"WITH {BASE}, {HITS}, {SCORES}, {PAIRED} SELECT count(*) AS topics, round(avg(d), 6) AS delta, count(CASE WHEN abs(d) < 1e-12 THEN 1 END) AS ties FROM d")
add("q_compare_baseline", f"WITH {BASE}, {HITS}, {SCORES} SELECT name, query_id, round(ap, 6) AS ap, round(ap - max(CASE WHEN name = 'vector' THEN ap END) OVER (PARTITION BY query_id), 6) AS delta FROM sc")
add("q_ttest_stat", f"WITH {BASE}, {HITS}, {SCORES}, {PAIRED} SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) AS n FROM d")
add("q_cohens_dz", f"WITH {BASE}, {HITS}, {SCORES}, {PAIRED} SELECT round(avg(d) / stddev_samp(d), 6) AS dz FROM d")
MODELS = ("vector", "vector_idf", "vector_prf", "bm25", "hybrid")


def runs(index: Index, models: tuple[str, ...] = MODELS, depth: int = 100) -> DataFrame:
    """name, query_id, doc_id, rank of the rankers over the topics."""
    given = {n: dict.fromkeys(t, 1.0) for n, t in topics.topics(index).items()}
    out = None
    for model in models:
        own = ranking.rank(index, given, model, depth).select(F.lit(model).alias("name"), "query_id", "doc_id", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def precisions(index: Index) -> dict[str, dict[int, float]]:
    """Average precision by ranker and topic, for topics with a relevant document: rankers times topics of numbers."""
    grade = F.conv(F.substring(F.md5((F.col("query_id") * 100003 + F.col("doc_id")).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    found = checkpointed(runs(index)).withColumn("rel", grade.isin(2, 3).cast("int"))
    all_of = found.where("rel = 1").groupBy("query_id").agg(F.countDistinct("doc_id").alias("r"))
    hits = F.sum("rel").over(Window.partitionBy("name", "query_id").orderBy("rank"))
    rows = found.withColumn("hits", hits).groupBy("name", "query_id").agg(F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("s")).join(all_of, "query_id").collect()
    out: dict[str, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r.name, {})[r.query_id] = r.s / r.r
    return out


def _compared(index: Index) -> DataFrame:
    """All pairs of rankers on the topics that both have: difference, ties, permutation p and its correction over all pairs, t and effect."""
    found, rows = precisions(index), []
    names = [m for m in MODELS if m in found]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = sorted(found[a].keys() & found[b].keys())
            d = [found[a][q] - found[b][q] for q in both]
            t, p_t = significance.student(d)
            rows.append((a, b, len(d), sum(d) / len(d) if d else 0.0, sum(abs(x) < 1e-12 for x in d), significance.permutation(d) if d else 1.0, significance.wilcoxon(d), t, p_t, significance.effect(d)))
    corrected = significance.holm([r[5] for r in rows])
    schema = "a string, b string, topics int, delta double, ties int, p double, p_wilcoxon double, t double, p_t double, d_z double, corrected double"
    return index.spark.createDataFrame([(*r, c) for r, c in zip(rows, corrected, strict=True)], schema)


register("q_compare_all", lambda spark, sf_dir: _compared(Index.of(spark, sf_dir)))
register("q_holm", lambda spark, sf_dir: _compared(Index.of(spark, sf_dir)).select("a", "b", "p", "corrected"))
add("q_duplicate_results", f"WITH {BASE} SELECT name, query_id, doc_id, count(*) AS times FROM (SELECT * FROM run100 UNION ALL SELECT * FROM run100 WHERE rank <= 2) GROUP BY name, query_id, doc_id HAVING count(*) > 1")
add("q_query_drilldown", f"WITH {BASE} SELECT q.query_id, q.doc_id, coalesce(v.rank, 0) AS rank, q.is_rel, q.gain FROM qrel q LEFT JOIN (SELECT * FROM run100 WHERE name = 'vector') v ON v.query_id = q.query_id AND v.doc_id = q.doc_id WHERE v.doc_id IS NOT NULL OR q.is_rel")
add("q_trec_run", f"WITH {BASE} SELECT concat(@text(query_id), ' Q0 ', @text(doc_id), ' ', @text(rank), ' ', @six(round(score, 6)), ' ', name) AS line FROM run100")
add("q_trec_qrels", f"WITH {BASE} SELECT concat(@text(query_id), ' 0 ', @text(doc_id), ' ', @text(gain)) AS line FROM qrel")
add("q_pool_merge", f"WITH {BASE}, lists AS (SELECT query_id, doc_id, name AS source, rank, 1 AS precedence FROM run WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'oracle', 1, 2 FROM qrel WHERE gain = 3 UNION ALL SELECT query_id, doc_id, 'random', 1, 3 FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat('7:', @text(query_id), ':', @text(doc_id)))) AS i FROM qrel) WHERE i <= 3) SELECT query_id, doc_id, min(rank) AS depth, CASE min(precedence) WHEN 1 THEN 'run_union' WHEN 2 THEN 'oracle' ELSE 'random' END AS source, count(*) AS lists FROM lists GROUP BY query_id, doc_id")
POOLED = ("vector", "vector_idf", "vector_prf", "bm25")


def _pooled(index: Index) -> DataFrame:
    """The twenty best of four rankers for every topic: how many have each document, and its best rank."""
    return runs(index, POOLED, 20).groupBy("query_id", "doc_id").agg(F.min("rank").alias("depth"), F.count("*").alias("runs"))


_BY = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r"
register(
    "q_pool_build",
    lambda spark, sf_dir: _pooled(Index.of(spark, sf_dir)),
    render(
        f"WITH {INDEX}, {TOPICS}, {LEN}, {VECTOR}, {BM25}, {VIDF}, {PRF}, {EXPANDED}, lists AS ({' UNION ALL '.join(f'SELECT query_id, doc_id, {_BY} FROM {t}' for t in ('vector', 'bm25', 'vector_idf', 'prf'))}) "
        "SELECT query_id, doc_id, min(r) AS depth, count(*) AS runs FROM lists WHERE r <= 20 GROUP BY query_id, doc_id",
        1,
    ),
)
add("q_pool_upsert", f"WITH {BASE}, old AS (SELECT query_id, doc_id, rank AS depth, 1 AS src FROM run WHERE name = 'vector' AND rank <= 10), new AS (SELECT query_id, doc_id, rank AS depth, 2 AS src FROM run WHERE name = 'bm25' AND rank <= 10) SELECT query_id, doc_id, min(depth) AS depth, min(src) AS src FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY query_id, doc_id")
add("q_pool_stats", f"WITH {BASE}, p AS (SELECT DISTINCT name, query_id, doc_id FROM run WHERE rank <= 10) SELECT p.name, count(*) AS entries, count(CASE WHEN q.is_rel THEN 1 END) AS relevant, round(count(CASE WHEN q.is_rel THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS relevant_rate FROM p LEFT JOIN qrel q ON q.query_id = p.query_id AND q.doc_id = p.doc_id GROUP BY p.name")
ASSESSED = "a AS (SELECT doc_id % 40 AS query_id, doc_id, x.assessor, @hash(doc_id * 31 + x.assessor) % 5 AS g FROM documents CROSS JOIN (SELECT @each(@range(1 | 3)) AS assessor) x WHERE @hash(doc_id * 7 + x.assessor) % 3 > 0)"
OR_AND = "SELECT query_id, doc_id, {0}(g >= 2 AND g < 4) AS is_relevant, bool_and(g = 4) AS is_unjudged, round(avg(CASE WHEN g < 4 THEN g ELSE 0 END), 6) AS gain, count(DISTINCT assessor) AS assessors, count(DISTINCT CASE WHEN g < 4 THEN g ELSE 0 END) > 1 AS has_disagreement FROM a GROUP BY query_id, doc_id"
add("q_qrels_or", f"WITH {ASSESSED} " + OR_AND.format("bool_or"))
add("q_qrels_and", f"WITH {ASSESSED} " + OR_AND.format("bool_and"))
add("q_agreement", f"WITH {ASSESSED}, p AS (SELECT query_id, doc_id, count(DISTINCT g) AS grades, count(DISTINCT g >= 2) AS sides FROM a GROUP BY query_id, doc_id HAVING count(*) > 1) SELECT count(*) AS pairs, round(count(CASE WHEN grades = 1 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS exact, round(count(CASE WHEN sides = 1 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS two_sided FROM p")
add("q_grade_counts", f"WITH {ASSESSED} SELECT g AS grade, count(*) AS n FROM a GROUP BY g")
add("q_pending_pairs", f"WITH {ASSESSED} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id AND a.assessor = 1)")
add("q_blind_order", f"WITH {ASSESSED} SELECT doc_id, row_number() OVER (ORDER BY md5(concat('1:', @text(doc_id % 40), ':', @text(doc_id)))) AS place FROM documents d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id AND a.assessor = 1)")
add("q_topic_counts", "SELECT lang AS category, count(*) AS topics, count(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 END) AS judged FROM documents GROUP BY lang")
add("q_stratified_sample", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, @long(floor(100 * n / CAST(sum(n) OVER () AS DOUBLE))) AS quota FROM c), e AS (SELECT q.lang, quota + CASE WHEN row_number() OVER (ORDER BY lang) <= 100 - sum(quota) OVER () THEN 1 ELSE 0 END AS quota FROM q) SELECT s.doc_id, s.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('11:', @text(doc_id)))) AS i FROM documents) s JOIN e ON e.lang = s.lang WHERE s.i <= e.quota")
add("q_unpooled_topics", f"WITH {BASE}, pooled AS (SELECT DISTINCT query_id FROM run WHERE rank <= 10 AND query_id < 5) SELECT DISTINCT t.query_id FROM topic t WHERE NOT EXISTS (SELECT 1 FROM pooled p WHERE p.query_id = t.query_id)")
add("q_collection_summary", f"WITH {TF}, {DF} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS topics, (SELECT count(*) FROM labels) AS judgments, (SELECT count(*) FROM df) AS terms")
add("q_metric_caveats", f"WITH {BASE} SELECT bool_and(r = 1 AND nr = 0) AS known_item, bool_and(nr > 0) AS has_negatives, min(r) AS least_relevant FROM r")
add("q_order_stability", f"WITH {ASSESSED}, f AS (SELECT query_id, sum(CASE WHEN g >= 2 AND g < 4 THEN 1 ELSE 0 END) AS o, min(CASE WHEN g >= 2 AND g < 4 THEN 1 ELSE 0 END) AS n FROM a GROUP BY query_id), x AS (SELECT query_id, row_number() OVER (ORDER BY o DESC, query_id) AS by_or, row_number() OVER (ORDER BY n DESC, query_id) AS by_and FROM f) SELECT count(*) AS topics, count(CASE WHEN by_or = by_and THEN 1 END) AS stable FROM x")
add("q_metric_registry", "SELECT name, edition FROM (VALUES ('precision', 'official'), ('recall', 'official'), ('f1', 'official'), ('average_precision', 'official'), ('precision_at_5', 'official'), ('precision_at_10', 'official'), ('r_precision', 'official'), ('eleven_points', 'official'), ('bpref', 'reconstruction'), ('bpref_10', 'extension'), ('reciprocal_rank', 'extension'), ('ndcg_5', 'extension'), ('ndcg_10', 'extension'), ('err', 'extension'), ('pfound', 'extension'), ('retrieved', 'diagnostic'), ('relevant', 'diagnostic'), ('relevant_retrieved', 'diagnostic'), ('unjudged_retrieved', 'diagnostic')) AS t(name, edition)")
add("q_seed_topics", "WITH seed AS (SELECT item_id AS query_id, substring(text, 1, 80) AS title FROM benchmark), kept AS (SELECT query_id, concat('kept: ', title) AS title FROM seed WHERE query_id % 3 = 0) SELECT query_id, title FROM kept UNION ALL SELECT query_id, title FROM seed s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.query_id = s.query_id)")
add("q_qrels_by_topic", f"WITH {BASE} SELECT query_id, @join(concat(@text(doc_id), ':', @text(gain)) | ',' | doc_id) AS judged, count(*) AS n FROM qrel GROUP BY query_id")
