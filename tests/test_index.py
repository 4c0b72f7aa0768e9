"""The stored index and its rankers against counts by hand and plain rankers."""

import math
import os
import random
import re
from collections import Counter

import pytest

from lexweave.operators import ranking
from lexweave.sources import index as index_module
from lexweave.sources.folders import shared_folder
from lexweave.sources.index import Conflict, Index


def counts_of(texts):
    merged = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0], x[1] or "")):
        if i is not None:
            merged.setdefault(i, []).append(t or "")
    return {i: [(p, w) for p, w in enumerate(re.findall(r"[^\W\d_]+", "\n".join(ts).lower())) if len(w) >= 2] for i, ts in merged.items()}


def plain(texts, queries, model):
    counts = {i: Counter(w for _, w in found) for i, found in counts_of(texts).items()}
    n, df = len(counts), Counter(w for c in counts.values() for w in c)
    idf = {w: 0.0 if df[w] >= n else math.log(n / df[w]) for w in df}
    average = sum(sum(c.values()) for c in counts.values()) / n
    out = {}
    for number, terms in queries.items():
        weight = {w: x if model == "sparse" else idf[w] if model == "vector_idf" else 1.0 for w, x in terms.items() if w in df}
        for i, c in counts.items():
            size = sum(c.values())
            if model == "bm25":
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / average)) for w in weight if c[w])
                if any(c[w] for w in weight):
                    out.setdefault(number, {})[i] = score
            elif (dot := sum(c[w] * idf[w] * x for w, x in weight.items())) > 0:
                out.setdefault(number, {})[i] = dot / math.sqrt(sum((t * idf[w]) ** 2 for w, t in c.items())) / math.sqrt(sum(x * x for x in weight.values()))
    return {q: sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0])) for q, s in out.items()}


def texts_of():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "délta", "x", "omega", "sigma", "tau"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 20)))) for i in range(60)] + [(60, None), (61, ""), (62, "alpha " * 5000)]
    return texts + [(5, "alpha beta beta"), (5, "tau"), (7, texts[7][1]), (None, "alpha"), (None, None)]  # repeated ids, and none


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


QUERIES = {1: {"alpha": 1.0, "tau": 0.5}, 2: {"délta": 2.0, "beta": 1.0, "unknown": 3.0}, 3: {"nothing": 1.0}}


@pytest.mark.parametrize("model", ["vector", "vector_idf", "sparse", "bm25"])
def test_rankers_equal_plain_ones(spark, built, model):
    index, texts = built
    truth = plain(texts, QUERIES, model)
    for k, offset in ((10, 0), (7, 5)):
        got = ranking.rank(index, QUERIES, model, k, offset).orderBy("query_id", "rank").collect()
        for q, best in truth.items():
            own = [x for x in got if x.query_id == q]
            assert [x.doc_id for x in own] == [i for i, _ in best[offset : offset + k]] and all(x.total == len(best) for x in own)
            assert all(abs(x.score - s) < 1e-9 for x, (_, s) in zip(own, best[offset : offset + k], strict=True)) and [x.rank for x in own] == list(range(offset + 1, offset + len(own) + 1))
        assert {x.query_id for x in got} == set(truth)
    with pytest.raises(ValueError):
        ranking.rank(index, QUERIES, "other")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    texts = texts_of()
    return Index.build(frame(spark, texts), str(tmp_path_factory.mktemp("index"))), texts


def state(index):
    """Everything that a version holds, in order."""
    own = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)
    return [own(index.postings()), own(index.forward()), own(index.table("terms")), own(index.table("documents").drop("segment")), index.manifest["documents"], index.manifest["terms"], index.manifest["postings"], index.manifest["avgdl"]]


def test_postings_have_all_places_and_one_document_an_id(built):
    index, texts = built
    truth = {(i, w): [p for p, x in found if x == w] for i, found in counts_of(texts).items() for w in {x for _, x in found}}
    rows = index.postings().collect()
    assert {(r.doc_id, r.term): r.positions for r in rows} == truth and len(rows) == len(truth)
    assert all(r.tf == len(r.positions) and r.len == len(counts_of(texts)[r.doc_id]) for r in rows)
    assert index.manifest["documents"] == 63 == index.table("documents").count() and index.manifest["postings"] == len(rows)
    assert math.isclose(index.manifest["avgdl"], sum(map(len, counts_of(texts).values())) / 63)


def test_additions_and_deletions_equal_a_rebuild(spark, tmp_path):
    texts = {i: t for i, t in texts_of() if i is not None}
    path = str(tmp_path / "index")
    index = Index.build(frame(spark, list(texts.items())[:40]), path)
    first = state(index)
    index = index.add(frame(spark, list(texts.items())[40:]))
    index = index.add(frame(spark, [(1, "new words alpha"), (99, "tau tau")]))  # replaces 1
    index = index.delete(spark.createDataFrame([(2,), (3,), (None,), (12345,)], "doc_id long"))
    index = index.add(frame(spark, [(3, "back again")]))
    now = {**texts, 1: "new words alpha", 99: "tau tau", 3: "back again"}
    del now[2]
    whole = state(Index.build(frame(spark, list(now.items())), str(tmp_path / "whole")))
    assert state(index) == whole and index.number == 5
    assert state(Index(spark, path, 1)) == first  # an earlier version is still there
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in ranking.rank(index, QUERIES, "vector", 9).collect()}
    assert got == {(q, i): (d, round(s, 9)) for q, best in plain(list(now.items()), QUERIES, "vector").items() for i, (d, s) in enumerate(best[:9], 1)}
    small = index.compact()
    assert state(small) == whole and len(small.manifest["segments"]) == 1
    small.vacuum()
    assert Index.versions(spark, path) == [6] and state(Index(spark, path)) == whole
    assert len(os.listdir(f"{path}/segments")) == 1 == len(os.listdir(f"{path}/versions"))
    gone = Index(spark, path).delete(spark.createDataFrame([(i,) for i in now], "doc_id long"))
    assert gone.manifest["documents"] == 0 and ranking.rank(gone, QUERIES).count() == 0


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    before = state(Index.build(frame(spark, [(1, "one two"), (2, "two three")]), path))
    steps = ["_stored", "_alive", "create"]
    for step in steps:
        with monkeypatch.context() as m:
            def broken(*a, **k):
                raise OSError("lost")

            m.setattr(*((index_module, "create") if step == "create" else (Index, step)), broken)
            for change in (lambda: Index(spark, path).add(frame(spark, [(3, "four")])), lambda: Index.build(frame(spark, [(9, "nine")]), path), lambda: Index(spark, path).compact()):
                with pytest.raises(OSError):
                    change()
        assert Index.versions(spark, path) == [1] and state(Index(spark, path)) == before
    one, other = Index(spark, path), Index(spark, path)
    one.delete(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(Conflict):
        other.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert Index(spark, path).manifest["documents"] == 1


def test_fusion_leaves_out_a_list_that_fails(spark, built):
    from pyspark.errors import AnalysisException

    index, texts = built
    lists = [plain(texts, QUERIES, m) for m in ("vector", "bm25")]
    semantic = [(1, 5, 0.9), (1, 200, 0.8)]

    def missing():
        return spark.read.parquet("/no/such/folder")

    with pytest.raises(AnalysisException):
        missing()
    for more, extra in (((), []), ((missing, lambda: None), []), ((lambda: spark.createDataFrame(semantic, "query_id long, doc_id long, score double"),), semantic)):
        score = Counter()
        for best in lists:
            for q, found in best.items():
                for place, (i, _) in enumerate(found[: ranking.DEPTH], 1):
                    score[q, i] += 1 / (60 + place)
        for place, (q, i, _) in enumerate(extra, 1):
            score[q, i] += 1 / (60 + place)
        got = {(r.query_id, r.doc_id): r.score for r in ranking.fused(index, QUERIES, more).collect()}
        assert got.keys() == score.keys() and all(math.isclose(got[k], score[k]) for k in got)


def test_rocchio_by_hand():
    found = ranking.rocchio({"a": 1.0}, [{"a": 0.6, "b": 0.8}, {"b": 1.0}], [{"c": 1.0}], 1.0, 0.75, 0.15)
    assert {t: round(w, 9) for t, w in found.items()} == {"a": 1.225, "b": 0.675, "c": -0.15}
    query = {"a": 1.0, "e": 2.0}
    assert ranking.rocchio(query, [{"a": 0.3}], [{"e": 0.9}], 1.0, 0.0, 0.0) == query
    assert ranking.rocchio({"a": 1.0}, [], [], 1.0, 0.75, 0.15) == {"a": 1.0}
    vector = {"a": 0.2, "b": -0.5, "c": 0.9, "d": 0.0, "e": 0.9, "f": 0.4}
    assert ranking.heaviest(vector, 3) == {"c": 0.9, "e": 0.9, "f": 0.4}
    assert list(ranking.heaviest({"i": 0.5, "b": 0.5, "g": 0.5}, 2)) == ["b", "g"]
    assert ranking.heaviest({"a": 0.1, "b": -0.9}, 5, negative=True) == {"b": -0.9, "a": 0.1}
    assert ranking.changed({"a": 1.0, "b": 1.0, "c": 0.5}, {"a": 1.0, "b": 1.4, "d": 0.3}) == {"a": "same", "b": "changed", "c": "dropped", "d": "added"}


def test_index_is_built_once_and_anew_when_files_change(spark, tmp_path):
    folder = str(tmp_path)
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    write([(1, "one two")])
    first = Index.of(spark, folder)
    assert Index.of(spark, folder).path == first.path and first.path.startswith(shared_folder(spark))
    write([(1, "one two"), (2, "two three")])
    again = Index.of(spark, folder)
    assert again.path != first.path and again.table("terms").count() == 3
    write([])
    assert Index.of(spark, folder).table("stats").first().documents == 0


def test_queries_find_commands_in_long_utterances(spark, tmp_path):
    from lexweave.plans import all_queries

    said = [(1, 0, "user", "well then after all of that talk could you please read me the next section"), (2, 0, "user", "read faster"), (3, 0, "user", "")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in all_queries()["q_command_fuzzy"](spark, str(tmp_path)).collect()}
    assert found[1].command == "next" and found[1].ratio == 90.0 and found[2].command == "faster" and found[2].ratio == 100.0 and found[3].ratio == 0.0


def test_ngrams_of_whole_texts(spark, tmp_path):
    from lexweave.plans import all_queries

    long = "abcdefghij" * 6
    spark.createDataFrame([(1, long + " a b c", "en", "s", 66)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {r.gram: r.n for r in all_queries()["q_ngrams"](spark, str(tmp_path)).collect()}
    word = f"_{long}_"
    truth = Counter(word[i : i + k] for k in range(1, 6) for i in range(len(word) - k + 1))
    assert grams == truth
    rows = {(r.pos, r.n): r.gram for r in all_queries()["q_candidate_ngrams"](spark, str(tmp_path)).collect()}
    assert rows[0, 4] == f"{long} a b c" and len(rows) == 6


def test_texts_stay_where_they_are_read_unless_an_id_is_met_twice(spark):
    plan = lambda rows: index_module.analysed(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan([(1, "one two"), (2, None)]) and "Exchange" in plan([(1, "one two"), (1, "two")])


@pytest.mark.parametrize("common", [1, 5, 1 << 20])
def test_norms_of_common_and_rare_terms(spark, tmp_path, monkeypatch, common):
    texts = [(i, " ".join(["every"] * 3 + ["second"] * (i % 2) + ["third"] * (2 if i % 3 == 0 else 0) + [f"own{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}"])) for i in range(60)]
    monkeypatch.setattr(index_module, "COMMON", common)
    index = Index.build(frame(spark, texts), str(tmp_path / "index"))
    counts = {i: Counter(w for _, w in found) for i, found in counts_of(texts).items()}
    df = Counter(w for c in counts.values() for w in c)
    norms = {r.doc_id: r.norm for r in index.table("documents").collect()}
    assert norms == pytest.approx({i: math.sqrt(sum((t * math.log(60 / df[w])) ** 2 for w, t in c.items())) for i, c in counts.items()})
    assert {(r.doc_id, r.term): (r.tf, len(r.positions)) for r in index.postings().collect()} == {(i, w): (t, t) for i, c in counts.items() for w, t in c.items()}


def test_norms_send_only_the_postings_of_rare_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "COMMON", 5)
    index = Index.build(frame(spark, [(i, f"every {'second' if i % 2 else ''} own{'abcdefghij'[i]}") for i in range(10)]), str(tmp_path / "index"))
    counts = index.forward().select("doc_id", "term", "tf")
    plan = index._norms(counts, index.table("terms"), index.manifest["postings"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "LeftAnti" in plan and plan.count("Exchange hashpartitioning(term") == 2  # rare postings, rare terms


def test_measures_do_not_shuffle_postings_to_weigh_them(spark, tmp_path):
    from lexweave.plans import all_queries

    spark.createDataFrame([(i, f"every word number{'abc'[i % 3]}", "en", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = all_queries()["q_trec_qrels"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "strategy=broadcast" in plan
