"""Queries that read all rows."""

from datetime import datetime

from lexweave.plans import all_queries


def test_no_ids_are_left_out(spark, tmp_path):
    folder = str(tmp_path)
    docs = [(i, "one two three", "en", "a", 13) for i in (1, 60, 150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "one two")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, datetime(2024, 1, i)) for i in (1, 2, 7)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    talks = [(3, 0, "user", "the same words"), (4, 0, "user", "the same words"), (10, 0, "user", "other things")]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    rows = lambda name: all_queries()[name](spark, folder).collect()
    assert {r.doc_id for r in rows("q_wsd")} == {1, 60, 150} == {r.doc_id for r in rows("q_rouge_n")}
    assert {r.o_orderkey for r in rows("q_parse_date")} == {1, 2, 7}
    assert {(r.qc, r.conv_id) for r in rows("q_tm_search")} == {(3, 4), (4, 3)}
    assert {(3, 4), (4, 3)} <= {(r.qc, r.conv_id) for r in rows("q_tm_best")}
