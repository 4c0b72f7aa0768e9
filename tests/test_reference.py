"""The text operators against values worked out by hand, and the query registry."""

import math

import duckdb

import pytest

from lexweave.operators import significance, text
from lexweave.plans import all_oracles, all_queries
from lexweave.plans.dialect import render


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hand"))
    rows = [(1, "vector vector vector model model search", "en", "a", 1), (2, "vector search search", "en", "a", 1), (3, "model engine engine engine engine", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def rows(spark, corpus, name, *key):
    return {tuple(r[k] for k in key): r for r in all_queries()[name](spark, corpus).collect()}


def test_weights_of_the_hand_corpus(spark, corpus):
    idf = rows(spark, corpus, "q_idf", "term")
    assert idf["vector",].idf == round(math.log(1.5), 6) and idf["engine",].idf == round(math.log(3), 6)
    raw = rows(spark, corpus, "q_raw_weights", "doc_id", "term")
    assert raw[1, "vector"].raw == 1.216395 and raw[1, "model"].raw == 0.81093 and raw[1, "search"].raw == 0.405465
    w = rows(spark, corpus, "q_normalized_weights", "doc_id", "term")
    for term, tf in (("vector", 3), ("model", 2), ("search", 1)):
        assert abs(w[1, term].w - tf / math.sqrt(14)) < 1e-6
    assert abs(w[2, "search"].w - 2 / math.sqrt(5)) < 1e-6
    assert abs(w[3, "engine"].w - 0.995770335768905) < 1e-6 and abs(w[3, "model"].w - 0.09187730080211556) < 1e-6
    keywords = rows(spark, corpus, "q_top_keywords", "doc_id", "k")
    assert [keywords[3, k].term for k in (1, 2)] == ["engine", "model"]
    stats = all_queries()["q_collection_stats"](spark, corpus).first()
    assert (stats.documents, stats.terms, stats.postings) == (3, 4, 7)


def test_dialects():
    assert render("@size(@words(x))", 1) == r"CAST(len(regexp_extract_all(lower(x), '\p{L}+')) AS BIGINT)"
    assert render(r"@rr(a | '\p{L}' | 'b | c')", 0) == r"regexp_replace(a, '\\p{L}', 'b | c')"
    assert set(all_oracles()) <= set(all_queries()) and len(all_oracles()) > 150


def test_sentences_keep_abbreviations():
    t = "See Fig. 3 for this. A. Smith et al. wrote it! And then? Yes."
    assert [t[a:b] for a, b in text.sentences(t)] == ["See Fig. 3 for this.", "A. Smith et al. wrote it!", "And then?", "Yes."]
    assert text.sentences(None) == [] and text.sentences("  \n ") == []


def test_procedures():
    ranks = text.textrank(["the cat sat on the mat", "the cat ran on the mat", "nothing else here"])
    assert abs(sum(ranks) - 1) < 1e-4 and ranks[0] == ranks[1] > ranks[2]
    assert text.textrank([]) == []
    assert text.mmr([1.0, 0.9, 0.5], [{"a"}, {"a"}, {"b"}], 2, 0.5) == [0, 2]
    assert text.lcs(list("abcbdab"), list("bdcaba")) == 4
    part, hits = text.snippet("one two three", {"two"})
    assert part[slice(*hits[0])] == "two" and text.snippet(None, {"x"}) == ("", [])
    assert text.links('<a href="/x#y"><a rel="nofollow" href="/z"><a href="/x">', "http://h/") == ["http://h/x"]
    assert text.words_to_digits("go to section twenty one now") == "go to section 21 now"
    assert text.words_to_digits("two hundred five") == "205" and text.words_to_digits(None) == ""


def test_significance():
    assert significance.permutation([0.0] * 5, 100) == 1.0
    assert significance.permutation([1.0] * 12, 2000) < 0.01
    assert significance.wilcoxon([1, 2, 3]) == 1.0 and significance.wilcoxon([i + 0.5 for i in range(12)]) < 0.01
    t, p = significance.student([1.0, 2.0, 3.0, 4.0])
    assert abs(t - 3.872983346) < 1e-8 and abs(p - 0.030466291) < 1e-8 and abs(significance.effect([1.0, 2.0, 3.0, 4.0]) - 1.936491673) < 1e-8
    assert significance.student([1.0, 1.0]) == (None, 1.0) == significance.student([]) and abs(significance.beta_share(2, 3, 0.4) - 0.5248) < 1e-12
    assert [round(x, 9) for x in significance.holm([0.01, 0.04, 0.03, 0.005])] == [0.03, 0.06, 0.06, 0.02] and significance.holm([]) == [] and significance.holm([0.9, 0.8]) == [1.0, 1.0]
    low, high = significance.bootstrap([0.0, 1.0] * 20)
    assert low < 0.5 < high


def test_streams(spark, tmp_path):
    from datetime import datetime

    from lexweave.streaming import events

    data = [(i, datetime(2024, 1, 1, i // 4, 10 * (i % 4)), i % 2, "view" if i % 3 else "buy", 100.0 + 20 * i) for i in range(12)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    batch = events.windowed(table.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value"))
    assert sum(r.n for r in batch.collect()) == 12
    refused = events.circuit_breaker(spark, str(tmp_path), pause=1500)
    assert refused.where("refused").count() > 0 and refused.count() == 12


def test_page_procedures():
    from lexweave.operators import pages

    html = "<head><title>t</title></head><nav>menu</nav><p>One <b>bold</b> &amp; two</p><script>x</script><p>Three"
    assert pages.paragraphs(html) == ["One bold & two", "Three"] and pages.paragraphs(None) == []
    assert pages.main_text(html) is None
    rules = "User-agent: *\nDisallow: /private/"
    assert not pages.allowed(rules, "http://h/private/x") and pages.allowed(rules, "http://h/")
    assert not pages.allowed("", "http://h/", 403) and pages.allowed(rules, "http://h/private/x", 500)
    assert [b["kind"] for b in pages.blocks("# Head\n- item\n```\ncode\n```\ntext")] == ["heading", "item", "paragraph"]
    assert pages.units("a b, c d", 2) == ["a b,", "c d"] and pages.units(None) == []
    assert pages.without_echo("stop the quick fox now", "the quick fox") == "stop now"
    assert abs(sum(f["value"] for f in pages.hashed_grams("abc")) - 50) < 1e-9 and pages.hashed_grams("") == []


def test_units_echo_and_exact_ranks():
    from lexweave.operators import pages

    assert pages.units("one two, three four; five six", 3) == ["one two,", "three four;", "five six"]
    assert pages.units("a b $x, y$ c d", 3) == ["a b $x, y$ c d"] and pages.units("one two – three four", 3) == ["one two –", "three four"]
    assert pages.without_echo("next", "go to the next section") == "" and pages.without_echo("next", "the next one") == "next"
    # of the 64 signs of ranks 1 to 6 those with a sum of 21 or 0 are as far out
    assert significance.wilcoxon([1, 2, 3, 4, 5, 6]) == 2 / 64
    assert significance.wilcoxon([-1, 2, 3, 4, 5, 6]) == 4 / 64


def test_textrank_weighs_terms():
    parts = ["alpha beta", "alpha gamma", "beta delta"]
    even = text.textrank(parts)
    assert even[0] > even[1] and abs(even[1] - even[2]) < 1e-9
    only = text.textrank(parts, {"alpha": 1.0, "gamma": 0.0})
    assert abs(only[0] - only[1]) < 1e-9 and only[2] < only[1]


def test_sentence_weights_by_hand(spark, tmp_path):
    docs = [(1, "alpha beta beta. Gamma!\nalpha 1.5 delta.", "en", "a", 1), (2, "beta only.", "en", "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(spark, str(tmp_path), "q_sentence_scores", "doc_id", "i")
    w = lambda tf: 0.5 * (1 + tf / 2) * math.log(2)  # noqa: E731  alpha stands twice, gamma and delta once; beta is in both documents
    # sentences of document 1: [alpha beta beta. ] at 0, [Gamma!] at 17, [alpha 1.5 delta.] at 24 of 40 characters
    assert abs(got[1, 0].w - w(2)) < 1e-6
    assert abs(got[1, 1].w - (1 - 17 / 40) * (1 - 17 / 23) * w(1)) < 1e-6
    assert abs(got[1, 2].w - (1 - 24 / 40) * (w(2) + w(1))) < 1e-6 and (1, 3) not in got
    assert abs(got[1, 0].w_sqrt - w(2) / math.sqrt(3)) < 1e-6 and abs(got[1, 0].w_linear - w(2) / 3) < 1e-6


TEXTS = [
    "One. Two! Three? Four", "See e.g. this. And i.e. that.", "It is 1.5 m. A. S. Pushkin wrote. Done", 'He said "Go." Then (left.) Now', "a. small. letters. Big.", "No end\n\nNew line. \t Tail  ",
    "", "   ", "Wait... what? Wait... What?", "Mr. Smith met Dr. Jones. They left.", "No. 5 is alive. Version 2. Next", "x! y! Z", "Fin…  Ende", "(e.g. Foo) \"vol. Two\". End.", "\n lead. Ok",
]


def test_sentences_of_the_plans_are_those_of_the_splitter(spark):
    from lexweave.plans.dialect import render

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").createOrReplaceTempView("documents")
    base = duckdb.connect()
    base.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(["(?, ?)"] * len(TEXTS)) + ") t(doc_id, text)", [x for row in enumerate(TEXTS) for x in row])
    query = "SELECT doc_id, p, j, piece FROM @pieces q"
    for found in (sorted(map(tuple, spark.sql(render(query, 0)).collect())), sorted(base.execute(render(query, 1)).fetchall())):
        own = {}
        for i, p, _, piece in found:
            own.setdefault(i, []).append((p, piece))
        for i, t in enumerate(TEXTS):
            pieces = own.get(i, [])
            assert [x.strip() for _, x in pieces if x.strip()] == [t[a:b] for a, b in text.sentences(t)], t
            assert ["".join(x for p, x in pieces if p == n) for n in range(t.count("\n") + 1)] == t.split("\n")


def test_snapshot(spark, tmp_path):
    from lexweave.sources import snapshot

    docs = spark.createDataFrame([(2, "u", "b", None), (1, "u", "a", " "), (3, None, "c", "en"), (4, None, "c", "en")], "doc_id long, url string, text string, lang string")
    snapshot.write_snapshot(docs, f"{tmp_path}/s", rows=1)
    assert len(list((tmp_path / "s").glob("*.json.gz"))) == 4
    (tmp_path / "s" / "junk.json").write_text("not json\n[]\n")
    got = snapshot.read_snapshot(spark, f"{tmp_path}/s", docs.schema, key="url", order="doc_id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", "a", "und"), (3, None, "c", "en"), (4, None, "c", "en")]
