"""Pairs of texts, block against block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import pairs
from lexweave.plans import all_queries


def texts(spark, sets, weights=None):
    rows = [(i, 0, float(len(set(words))), words, None if weights is None else [weights[w] for w in words]) for i, words in sets.items()]
    return spark.createDataFrame(rows, "id long, more long, size double, words array<string>, weights array<double>")


@pytest.fixture
def small(monkeypatch):
    """Blocks of few texts; queries that go by shuffle; some words common and others not."""
    for name, value in (("BLOCK", 7), ("SENT", 0), ("COMMON", 0.3), ("COLUMNS", 3), ("MATCHES", 20), ("GIVEN", 5)):
        monkeypatch.setattr(pairs, name, value)


def drawn(count, seed):
    some = random.Random(seed)
    return {i: sorted({f"w{int(some.paretovariate(0.7)) % 40}" for _ in range(some.randint(1, 9))}) for i in range(count)}


def test_all_pairs_that_share_a_word(spark, small):
    sets = drawn(60, 1)
    found = {(r.a, r.b): r.value for r in pairs.ratios(texts(spark, sets).where("id % 5 = 0"), texts(spark, sets), jaccard=True).collect()}
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() if a % 5 == 0 for b, y in sets.items() if a != b and set(x) & set(y)}
    assert found == want


def test_a_word_without_weight_is_shared(spark, small):
    sets = {0: ["a", "b"], 5: ["a"], 6: ["c"], 7: ["b", "c"]}
    weights = {"a": 0.0, "b": 2.0, "c": 1.0}
    found = {(r.a, r.b): r.value for r in pairs.ratios(texts(spark, sets, weights).where("id % 5 = 0"), texts(spark, sets, weights)).collect()}
    assert found == {(0, 5): 0.0, (0, 7): 4.0 / 4, (5, 0): 0.0}


def test_likest_and_like_among_themselves(spark, small):
    sets = drawn(50, 2) | {90: ["same", "words"], 91: ["words", "same"], 92: ["same", "words"], 93: ["alone"]}
    value = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    all_of = {a: sorted((-round(value(x, y), 9), b) for b, y in sets.items() if a != b and set(x) & set(y)) for a, x in sets.items()}
    assert {r.id: r.other_id for r in pairs.likest(texts(spark, sets)).collect()} == {a: own[0][1] for a, own in all_of.items() if own}
    found = [(r.id, r.other_id) for r in pairs.like(texts(spark, sets), 0.7).collect()]
    assert sorted(found) == sorted((a, b) for a, own in all_of.items() for v, b in own if -v >= 0.7)
    once = [(r.a, r.b) for r in pairs.ratios(texts(spark, sets), jaccard=True, least=0.7).collect()]
    assert sorted(once) == sorted(p for p in found if p[0] < p[1])


def test_products_of_repeated_words(spark):
    sets = texts(spark, {0: ["a", "a", "b"], 1: ["a", "b", "b"]})
    assert [r.value for r in pairs.ratios(sets.where("id = 0"), sets).collect()] == [(2 * 1 + 1 * 2) / (2.0 * 2.0)]
    assert np.isclose(pairs.ratios(sets, least=0.5).first().value, 1.0)


def test_pairs_are_not_shuffled(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("xx")).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text").write.parquet(f"{folder}/conversations.parquet")
    for name in ("q_cosine", "q_jaccard", "q_doc_similarity", "q_tm_search"):
        plan = all_queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan.partition("MapInArrow")[0].replace("AdaptiveSparkPlan", ""), name
    best = all_queries()["q_tm_best"](spark, folder)
    assert "MapInArrow" in best._jdf.queryExecution().executedPlan().toString() and best.count() == 200


def test_blocks_do_not_come_to_the_driver(spark):
    sets = texts(spark, drawn(30, 4))
    for df in (pairs.ratios(sets), pairs.ratios(sets.where("id % 5 = 0"), sets), pairs.like(sets, 0.7), pairs.likest(sets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Broadcast" not in plan
