"""Letter grams of languages and documents against DuckDB, and where they are counted."""

import duckdb

from lexweave.plans import all_oracles, all_queries

DOCS = [(1, "ab abc ab", "en", "a", 1), (3, "Öl und Öl", "de", "a", 1), (2, "abc x bab", "en", "a", 1), (4, "und oder", "de", "a", 1), (1, "bab", "en", "b", 1), (5, None, "en", "a", 1), (6, "ab", None, "a", 1), (7, "ab", None, "a", 1)]


def test_grams_are_counted_where_texts_are_read(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    base.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", DOCS)
    for name in ("q_ngrams", "q_lang_profiles", "q_out_of_place"):
        df = all_queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect()), key=str) == sorted(base.execute(all_oracles()[name]).fetchall(), key=str)
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [x for x in lines if "hashpartitioning(doc_id" in x and "gram" in x]
