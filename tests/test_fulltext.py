"""Full-text search against a scan of the texts."""

import math
import random
import re

import pytest

from lexweave.operators import fulltext
from lexweave.operators.fulltext import Branch, Leaf
from lexweave.operators.stemming import stem
from lexweave.sources.index import Index


def test_reading_queries():
    read = lambda q: fulltext.parse(q, stems=False)
    a, b, c = (Leaf(((w, 0),)) for w in ("aa", "bb", "cc"))
    assert read("aa") == a and read("") is None and read("or") is None and read('""') is None and read("x - y") is None
    assert read("aa bb") == Branch("and", (a, b)) and read("aa OR bb") == Branch("or", (a, b))
    assert read("aa bb or cc") == Branch("or", (Branch("and", (a, b)), c)) == read("or aa bb or or cc or")
    assert read("aa -bb") == Branch("and", (a, b._replace(wanted=False)))
    assert read('-"aa bb" cc') == Branch("and", (Leaf((("aa", 0), ("bb", 1)), False), c))
    assert read('"aa x bb"') == Leaf((("aa", 0), ("bb", 2))) and read("aa-bb") == read('"aa bb"')
    assert read('aa "bb cc') == Branch("and", (a, b, c))
    assert fulltext.parse('"the running dogs" of', stems=True) == Leaf((("run", 0), ("dog", 1)))


def found_by(tree, words):
    if isinstance(tree, Branch):
        return (all if tree.kind == "and" else any)(found_by(p, words) for p in tree.parts)
    hit = any(all(p + i < len(words) and words[p + i] == w for w, i in tree.words) for p in range(len(words)))
    return hit == tree.wanted


def score_of(tree, words):
    own = {w: [i for i, x in enumerate(words) if x == w][:256] for w in fulltext.words_of(tree)}
    names = list(own)
    if fulltext.together(tree) and len(names) > 1:
        missed = 1.0
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                for d in (abs(x - y) for x in own[a] for y in own[b]):
                    if 0 < d <= 100:
                        missed *= 1 - 0.1 / math.sqrt(1.005 + 0.05 * math.exp(d / 1.5 - 2))
        s = 1 - missed
    else:
        s = sum(1 / j**2 for p in own.values() for j in range(1, len(p) + 1)) * 0.1 / 1.64493406685 / len(own)
    s /= math.log2(max(1, sum(len(w) > 1 for w in words)) + 1)
    return s / (s + 1)


QUERIES = ["cats dogs", "cats or dogs -bird", '"running dogs"', "-cats", "bird -dogs", "cats dogs or bird", '"dog a cat" or "cats run"', "the", "nothing", '-"cat dog" runs', "Dog-Cats", "", "cat or -dog"]


@pytest.mark.parametrize("stems", [False, True])
def test_search_equals_a_scan(spark, tmp_path, stems):
    r = random.Random(5)
    words = ["cat", "cats", "dog", "dogs", "run", "running", "runs", "bird", "a", "the", "Straße"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(90, None), (91, "cat " * 300 + "dogs"), (92, "1 cat2dog")]
    index = Index.build(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "index"))
    got = {(x.query_id, x.doc_id): (x.score, x.matched) for x in fulltext.search(index, dict(enumerate(QUERIES)), stems).collect()}
    truth = {}
    for n, query in enumerate(QUERIES):
        tree = fulltext.parse(query, stems)
        for i, text in texts if tree else ():
            own = [stem(w, "en") if stems and len(w) > 1 else w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
            if found_by(tree, own):
                truth[n, i] = score_of(tree, own), sum(w in own for w in fulltext.words_of(tree))
    assert got.keys() == truth.keys() and len(truth) > 200
    assert all(math.isclose(got[k][0], truth[k][0], abs_tol=1e-12) and got[k][1] == truth[k][1] for k in truth)


def test_phrases_of_many_rows(spark, tmp_path):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["aa", "bb", "cc", "x"]) for _ in range(30))) for i in range(40)]
    index = Index.build(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "index"))
    asked = {1: ["aa", "bb"], 2: ["aa", "aa", "cc"], 3: ["aa", "zz"], 4: ["cc"]}
    rows = [(n, w, i) for n, ws in asked.items() for i, w in enumerate(ws)]
    got = {(x.query_id, x.doc_id): x.times for x in fulltext.phrases(index, spark.createDataFrame(rows, "query_id long, term string, at int")).collect()}
    truth = {}
    for n, ws in asked.items():
        for i, t in texts:
            words = t.split()
            times = sum(words[p : p + len(ws)] == ws for p in range(30))
            if times:
                truth[n, i] = times
    assert got == truth


def test_phrases_of_rows_travel_nowhere(spark):
    docs = spark.createDataFrame([(1, "a bc de fg, bc de fg"), (2, "bc de. FG"), (3, None), (4, "bc de"), (5, "bc"), (5, "de fg")], "doc_id long, text string")
    found = fulltext.phrases_of(docs, spark.createDataFrame([(7, "bc de fg"), (8, "bc de fg")], "query_id long, phrase string"), 3)
    assert {(r.query_id, r.doc_id): r.times for r in found.collect()} == {(q, d): n for q in (7, 8) for d, n in ((1, 2), (2, 1), (5, 1))}
    plan = fulltext.phrases_of(docs.where("doc_id < 5"), spark.createDataFrame([(7, "bc de fg")], "query_id long, phrase string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(phrase" not in plan
