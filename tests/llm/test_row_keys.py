"""Near copies among rows with null and shared ids."""

import math
from collections import Counter

from lexweave.llm import mixing, ngrams
from tests.llm.fixtures import corpus, frame

words = lambda c: " ".join(c * k for k in range(1, 12))
ROWS = [(None, words("a")), (None, words("a")), (None, words("b")), (None, None), (1, words("c")), (1, words("d")), (2, words("e")), (2, words("e")), (3, words("e"))]


def test_null_and_shared_ids_stay(spark):
    kept = ngrams.one_of_each(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted([(0, words("a")), (0, words("b")), (0, ""), (1, words("c")), (1, words("d")), (2, words("e"))])


def test_components_of_null_and_shared_ids(spark):
    rows = [*ROWS, (7, words("d") + " " + words("f")), (8, words("d") + " " + words("f") + " tail"), (None, words("c")), (9, "x")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngrams.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    truth = [(0, 7, None), (0, 7, None), (0, 7, None), (0, 0, None), (1, 7, 1), (1, 7, 1), (2, 7, 2), (2, 7, 2), (3, 7, 2), (7, 18, 7), (8, 19, 7), (0, 7, 1), (9, 1, 9)]
    assert got == sorted(truth, key=str)


def test_a_very_long_text_and_its_copy(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short one here now yes")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


def test_the_mix_keeps_rows_without_id(spark, monkeypatch):
    rows = [(None, "one two three", "a"), (None, "four five", "a"), (1, "six", "b"), (1, "seven eight", "b"), (2, "", "b"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    placed = mixing.assign(docs).collect()
    taken = {(r.doc_id, r.size): r.taken for r in placed}
    assert len(placed) == 6
    for doc_id, text, _ in rows:
        size = len((text or "").split())
        assert sum(r.doc_id == doc_id and r.text == text for r in mixed) == (math.floor(taken[doc_id, size] / size + 0.5) if size else 0)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(str, mixing.assign(frame(spark)).collect())) == sorted(map(str, mixing.assign(frame(spark, corpus())).collect()))
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed))


def test_the_mix_takes_no_more_than_its_target_of_rows_without_id(spark):
    rows = [(None, f"four words in {i % 7}", None, "a", *[None] * 5) for i in range(50)] + [(1000 + i, "one two three four", None, "b", *[None] * 5) for i in range(40)]
    docs = frame(spark, rows)
    taken, targets = Counter(), {}
    for r in mixing.assign(docs).collect():
        source = "a" if r.doc_id is None else "b"
        taken[source] += r.taken
        targets[source] = r.target
    assert taken["a"] == math.floor(targets["a"]) and taken["b"] == math.floor(targets["b"])
    got = Counter(r.source for r in mixing.mix(docs).collect())
    for source, target in targets.items():
        assert abs(4 * got[source] - target) <= 4
    whole = mixing.sized(docs).where("doc_id IS NULL")
    assert mixing._bucketed(whole, 4096).select("bucket").distinct().count() == 7
