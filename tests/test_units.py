"""Longest dictionary units against a greedy walk."""

import random
import re
from collections import Counter

from lexweave.operators import units


def walk(texts, entries, most):
    keys = {k.lower() for k in entries if k and len(k.split(" ")) <= most}
    out = []
    for i, text in texts:
        for n, run in enumerate(re.findall(r"[^\W\d_]+(?: [^\W\d_]+)*", (text or "").lower())):
            words, at = run.split(" "), 0
            while at < len(words):
                size = next((k for k in range(min(most, len(words) - at), 0, -1) if " ".join(words[at : at + k]) in keys), 0)
                out.append((i, n, at, size or 1, " ".join(words[at : at + (size or 1)]), size > 0))
                at += size or 1
    return sorted(out, key=str)


def check(spark, texts, entries, most=7):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = units.units(docs, spark.createDataFrame([(e,) for e in entries], "key string"), most)
    assert sorted(map(tuple, found.collect()), key=str) == walk(texts, entries, most)


def test_units_equal_a_greedy_walk(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice(["a", "b", "c", "Öl"]) + r.choice([" ", " ", " ", " ", ", ", "  ", "-"]) for _ in range(n))
    texts = [(i, text(r.randint(0, 60))) for i in range(25)] + [(30, None), (31, ""), (32, "Machine learning, system. The machine learning system works"), (33, "a b c a b c a b"), (34, " a  b   c , a b "), (35, "c a " * 20_000)]
    entries = [" ".join(r.choice(["a", "b", "c", "öl"]) for _ in range(r.randint(1, 7))) for _ in range(40)]
    entries += ["machine learning", "machine", "learning", "machine learning system of the world in", None, "", "a b c a b c a b", "a b c a b c a", "a b"]
    check(spark, texts, entries)
    check(spark, texts, entries, most=3)
    check(spark, texts[:5], [])


def test_the_longest_wins_over_its_beginnings(spark):
    docs = spark.createDataFrame([(1, "the machine learning system works"), (1, "Machine, learning")], "doc_id long, text string")
    keys = [(r["key"], r.known) for r in units.units(docs.limit(1), spark.createDataFrame([("machine learning",), ("machine",), ("system",)], "key string")).orderBy("run", "at").collect()]
    assert keys == [("the", False), ("machine learning", True), ("system", True), ("works", False)]


def test_grams_of_documents_are_found_where_texts_are(spark):
    docs = spark.createDataFrame([(1, "a b c. a b"), (2, None), (3, "a")], "doc_id long, text string")
    found = units.grams(docs, (2, 3))
    assert sorted(map(tuple, found.collect())) == [(1, "a b"), (1, "a b c"), (1, "b c")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_frequent_stretches_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(units, "BLOCK", 300)
    some = random.Random(5)
    texts = [(i, "".join(some.choice(["a", "b", "c", "dd"]) + some.choice([" ", " ", " ", ", ", "  "]) for _ in range(some.randint(0, 25)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (60, None), (None, "a b c"), (7, "a b c dd")], "doc_id long, text string")
    texts[7] = (7, "\n".join(sorted([texts[7][1], "a b c dd"])))
    runs = {i: [r.split(" ") for r in re.findall(r"[a-z]+(?: [a-z]+)*", t)] for i, t in texts}
    had = Counter(k for own in runs.values() for k in {" ".join(w[i : i + n]) for w in own for n in (2, 3, 4) for i in range(len(w) - n + 1)})
    want = []
    for doc, own in runs.items():
        for run, w in enumerate(own):
            at = 0
            while at < len(w):
                size = next((n for n in (4, 3, 2) if at + n <= len(w) and had[" ".join(w[at : at + n])] >= 3), 1)
                if size > 1:
                    want.append((doc, run, at, size, " ".join(w[at : at + size])))
                at += size
    found = units.frequent(docs, most=4, least=3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and {r[3] for r in want} == {2, 3, 4}
    assert units.frequent(docs.limit(0), most=4, least=3).count() == 0
