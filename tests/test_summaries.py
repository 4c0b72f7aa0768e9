"""Sentences of documents against the splitter, and where they are worked out."""

from tests.test_reference import TEXTS

from lexweave.operators import summaries, text
from lexweave.plans import all_queries
from lexweave.sources.index import Index


def test_sentences_are_those_of_the_splitter():
    for t in TEXTS:
        assert [s.text.strip() for s in summaries.sentences(t)] == [t[a:b] for a, b in text.sentences(t) if summaries.letters().search(t[a:b])]
        assert all(t[s.start : s.start + len(s.text)] == s.text for s in summaries.sentences(t))
    assert summaries.sentences(None) == []


def test_no_words_travel_for_sentences(spark, tmp_path):
    rows = [(1, "Alpha beta beta. Gamma! Alpha delta.", "en", "a", 36), (2, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("q_summaries", "q_sentence_contributions", "q_sentence_edges"):
        plan = all_queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "tok" not in plan and "posexplode" not in plan
    assert [tuple(r) for r in all_queries()["q_summaries"](spark, str(tmp_path)).collect()] == [(1, 3, 36)]


def test_hamming_keeps_no_side_of_its_product_on_disk(spark, tmp_path):
    rows = [(i, f"words number w{i}", "en", "a", 10) for i in (1, 50, 100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = all_queries()["q_hamming"](spark, str(tmp_path))
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
        assert {(r.a, r.b) for r in df.collect()} == {(50, 1), (50, 100), (100, 1), (100, 50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quality_has_keywords_and_places(spark, tmp_path):
    filler = [f"Word{c} is here." for c in "abcdefghij"]
    rows = [(1, " ".join(filler), "en", "a", 149), (2, "Omega omega. Alpha!", "en", "a", 0), (3, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.asDict() for r in all_queries()["q_summary_quality"](spark, str(tmp_path)).collect()}
    # all sentences score the same, so that place alone picks the first five: five of the ten words that differ and the two that don't
    assert found[1]["keyword_coverage"] == round(7 / 12, 6) and (found[1]["content_top_kept"], found[1]["content_top_total"]) == (5, 5)
    assert found[1]["last_third"] == 0 and found[1]["mean_position"] == round(sum(15 * i for i in range(5)) / 5 / 149, 6)
    # a document without a number of characters has its summary measured all the same
    assert found[2] == {"doc_id": 2, "compression": 0.0, "lead_share": 0.5, "keyword_coverage": 1.0, "content_top_kept": 2, "content_top_total": 2, "mean_position": 0.342105, "last_third": 1}
    assert set(found) == {1, 2}


def test_sentences_do_not_travel_to_be_chosen(spark, tmp_path):
    said = ". ".join(f"Alpha{'abcdefghij'[i % 10]} beta{'abcdefghij'[i // 10]} gamma delta eta theta iota kappa" for i in range(60)) + "."
    rows = [(i, said, "en", "a", len(said)) for i in range(3)] + [(9, "Other words", "en", "a", 11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = all_queries()["q_sentence_contributions"](spark, str(tmp_path))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and found.where("doc_id < 9").groupBy("doc_id", "i").count().where("count = 6").count() == 180
    # few of the sixty sentences of a document leave its task
    index = Index.of(spark, str(tmp_path))
    assert summaries.selected(index, spark.read.parquet(f"{tmp_path}/documents.parquet")).groupBy("doc_id").count().where("count > 6").count() == 0
    assert [r.sentences for r in all_queries()["q_summaries"](spark, str(tmp_path)).orderBy("doc_id").collect()] == [5, 5, 5, 1]
