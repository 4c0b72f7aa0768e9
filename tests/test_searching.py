"""Searches and feedback sessions over a small collection."""

import math

import pytest
from pyspark.sql import functions as F

from lexweave.operators import feedback, ranking, searching
from lexweave.operators.feedback import Session
from lexweave.operators.vectors import VectorIndex
from lexweave.sources.index import Index

TEXTS = [
    (1, "alpha beta gamma", "en"), (2, "alpha alpha delta", "en"), (3, "beta delta delta epsilon", "de"), (4, "gamma zeta", "de"),
    (5, "alpha zeta zeta", None), (6, None, "en"), (7, "the running alpha dogs", "en"), (8, "epsilon beta", "en"),
]


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return docs, Index.build(docs, str(tmp_path_factory.mktemp("index")))


def test_every_model_gives_pages_that_filters_hold_for(spark, collection, tmp_path):
    docs, index = collection
    angle = lambda i: [math.cos(i / 3), math.sin(i / 3)]
    vectors = VectorIndex.build(spark.createDataFrame([(i, angle(i)) for i, *_ in TEXTS], "doc_id long, v array<double>"), str(tmp_path / "vectors"), cells=2)
    for model in searching.MODELS:
        ask = lambda **more: searching.search(index, docs, "alpha beta", model, vectors=vectors, vector=angle(1), **more).collect()  # noqa: E731, B023
        every = ask(k=50)
        assert [r.rank for r in every] == list(range(1, len(every) + 1)) and all(r.total == len(every) for r in every) and every
        assert [r.doc_id for r in ask(k=2, offset=1)] == [r.doc_id for r in every[1:3]]
        german = ask(k=50, where=F.col("lang") == "de")
        assert [r.doc_id for r in german] == [r.doc_id for r in every if r.doc_id in (3, 4)]
    assert {r.doc_id for r in searching.search(index, docs, '"run alpha" or -beta -alpha', "fts").collect()} == {4, 6, 7}
    assert searching.search(index, docs, "", log=str(tmp_path / "log")).count() == 0
    assert searching.search(index, docs.where("doc_id <> 1"), "gamma", log=str(tmp_path / "log")).first().doc_id == 4
    log = {r.query: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log["gamma"].returned == 1 and log[""].total == 0
    searching.search(index, docs, "gamma", log="/proc/none/log")
    assert searching.unknown(index, "Alpha omega x psi") == ["omega", "psi"]
    for bad in ("other", "semantic"):
        with pytest.raises(ValueError):
            searching.search(index, docs, "alpha", bad)


def vector_of(index, i):
    return ranking.document_vectors(index, [i])[i]


def test_a_session_moves_and_replays(spark, collection, tmp_path):
    _, index = collection
    path = str(tmp_path / "session")
    session = Session.start(index, path, ["alpha", "nowhere", "alpha"])
    assert session.terms == ["alpha"] and session.rounds() == 1
    assert session.mark([1, 1, 999], [5]) == 1 and session.mark([3]) == 2
    first = {"alpha": 1.0}
    one = ranking.heaviest(ranking.rocchio(first, [vector_of(index, 1)], [vector_of(index, 5)]))
    two = ranking.heaviest(ranking.rocchio(one, [vector_of(index, 3)], []))
    replayed = {}
    for r in Session(index, path).replay().collect():
        replayed.setdefault(r["round"], {})[r.term] = (r.weight, r.kind)
    for number, (before, now) in enumerate([({}, first), (first, one), (one, two)]):
        assert {t: w for t, (w, kind) in replayed[number].items() if kind != "dropped"} == pytest.approx(now)
        assert {t: kind for t, (_, kind) in replayed[number].items()} == ranking.changed(before, now)
    ranks = {n: {r.doc_id: r.rank for r in session.ranking(n).collect()} for n in range(3)}
    for n, vector in enumerate([first, one, two]):
        assert ranks[n] == {r.doc_id: r.rank for r in ranking.rank(index, {0: vector}, "sparse", 100).collect()}
        assert {r.doc_id: r.previous_rank for r in session.ranking(n).collect()} == {d: ranks[n - 1].get(d) if n else None for d in ranks[n]}
    assert sorted(map(tuple, session.marks().collect())) == [(1, 1, True), (1, 1, True), (1, 5, False), (1, 999, True), (2, 3, True)]
    for bad in (lambda: Session.start(index, str(tmp_path / "none"), ["nowhere"]), lambda: Session.start(index, path, ["alpha"])):
        with pytest.raises(ValueError):
            bad()
    other = Index.build(spark.createDataFrame(TEXTS, "doc_id long, text string, lang string"), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        Session(other, path)


def test_rounds_of_many_queries_are_those_of_sessions(spark, collection, tmp_path):
    _, index = collection
    judged = [(1, 1, True), (1, 5, False), (1, 2, None), (2, 8, True), (2, 8, True)]
    queries = {1: {"alpha": 1.0}, 2: {"beta": 1.0, "zeta": 1.0}, 3: {"nowhere": 1.0}}
    got = feedback.rounds(index, queries, spark.createDataFrame(judged, "query_id long, doc_id long, relevant boolean")).collect()
    assert {r.query_id for r in got} == {1, 2}
    for q in (1, 2):
        session = Session.start(index, str(tmp_path / f"s{q}"), list(queries[q]))
        for number in range(3):
            own = sorted((r.rank, r.doc_id, round(r.score, 9), r.previous_rank) for r in got if r.query_id == q and r["round"] == number)
            assert own == sorted((r.rank, r.doc_id, round(r.score, 9), r.previous_rank) for r in session.ranking(number).collect())
            seen = {d for _, d, *_ in own}
            session.mark([d for n, d, yes in dict.fromkeys(judged) if n == q and yes is True and d in seen], [d for n, d, yes in judged if n == q and yes is False and d in seen])


def test_feedback_moves_queries_without_fetching_vectors(spark, tmp_path, monkeypatch):
    from lexweave.operators import feedback, ranking
    from lexweave.sources.index import Index

    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "alpha delta delta"), (4, "tau")]
    index = Index.build(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/index")
    before = {1: {"alpha": 1.0}, 2: {"tau": 1.0}}
    own = ranking.document_vectors(index, [1, 2, 3])
    truth = {1: ranking.heaviest(ranking.rocchio(before[1], [own[1], own[2]], [own[3]])), 2: {"tau": 1.0}}
    monkeypatch.setattr(ranking, "document_vectors", None)
    got = feedback.moved(index, before, [(1, 1, True), (1, 2, True), (1, 3, False), (1, 99, True)], ranking.ALPHA, ranking.BETA, ranking.GAMMA)
    assert {q: {t: round(w, 9) for t, w in v.items()} for q, v in got.items()} == {q: {t: round(w, 9) for t, w in v.items()} for q, v in truth.items()}


def test_judgments_are_not_broadcast(spark, tmp_path):
    """Their size is estimated far below what they are: documents times queries."""
    spark.range(2000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/docs")
    judged = spark.read.parquet(f"{tmp_path}/docs").select("doc_id", F.explode(F.array(*(F.lit(n).cast("long") for n in range(30)))).alias("query_id")).withColumn("relevant", F.col("doc_id") % 2 == 0)
    ranks = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.4), (40, 1, 5, 0.5), (1, 3, 5, 0.1)], "query_id long, rank int, doc_id long, score double")
    found = feedback.marked(ranks, judged)
    broadcast = found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")
    assert len(broadcast) == 2 and "Generate" not in broadcast[1] and "Generate" in broadcast[0]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 5, False), (1, 6, True)]
