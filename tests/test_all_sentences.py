"""Long documents: all their sentences."""

from lexweave.plans import all_queries


def test_sentences_beyond_the_first_ones(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, " ".join(f"{chr(65 + i % 26)}aa words." for i in range(205)), "en", "a", 2050), (2, "other text.", "en", "a", 11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    scores = all_queries()["q_sentence_scores"](spark, folder).where("doc_id = 1").collect()
    assert sorted(r.i for r in scores) == list(range(205))
    edges = {(r.a, r.b) for r in all_queries()["q_sentence_edges"](spark, folder).collect()}
    assert (3, 204) in edges and len(edges) == 205 * 204 // 2
