"""The inverted file of vectors and the exact search against plain loops."""

import math

import numpy as np

from lexweave.operators import vectors
from lexweave.operators.vectors import VectorIndex


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "doc_id long, v array<double>")


def plain(queries, rows, k):
    ok = lambda v: v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)
    cosine = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))
    out = {}
    for q, v in queries:
        if ok(v):
            scores = [(i, cosine(v, x)) for i, x in rows if i != q and ok(x) and len(x) == len(v)]
            out[q] = sorted(scores, key=lambda s: (-round(s[1], 9), s[0]))[:k]
    return {q: s for q, s in out.items() if s}


def clusters(n=900, dim=12):
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, dim)) * 2
    rows = [(i, centres[i % 20] + r.standard_normal(dim)) for i in range(n)]
    return rows + [(n + i, rows[0][1] * 3) for i in range(30)]  # ties


BAD = [(-1, None), (-2, []), (-3, [0.0] * 12), (-4, [math.nan] * 12), (-5, [None] * 12), (-6, [1.0, 2.0]), (-7, [math.inf] + [1.0] * 11)]


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]])


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rows = clusters() + BAD
    asked = rows[:40] + BAD
    same(got(vectors.exact(table(spark, asked), table(spark, rows), 7)), plain(asked, rows, 7))
    monkeypatch.setattr(vectors, "SENT", 0)  # too many queries to broadcast
    same(got(vectors.exact(table(spark, asked), table(spark, rows), 7)), plain(asked, rows, 7))
    plan = vectors.exact(table(spark, asked), table(spark, rows), 7)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recall_of_the_inverted_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "DEALT", 100)  # the cell of the common vector is dealt
    monkeypatch.setattr(vectors, "ASKED", 20)
    rows = clusters()
    index = VectorIndex.build(table(spark, rows + BAD), str(tmp_path / "index"), k=10, cells=24)
    assert index.rows.count() == len(rows) and index.recall >= vectors.RECALL and 1 <= index.probes < 24
    asked = rows[::3]
    truth, found = plain(asked, rows, 10), got(index.search(table(spark, asked + BAD), 10))
    assert truth.keys() == found.keys()
    hits = sum(len({i for i, _ in truth[q]} & {i for i, _ in found[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    same(got(index.search(table(spark, asked), 10, probes=24)), truth)  # all cells: exact
    plan = index.search(table(spark, asked), 10)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_of_nothing(spark, tmp_path):
    index = VectorIndex.build(table(spark, BAD[:5]), str(tmp_path / "index"))
    assert index.search(table(spark, clusters()[:3])).count() == 0
