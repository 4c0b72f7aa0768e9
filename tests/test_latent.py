"""Latent axes against a dense decomposition."""

import numpy as np

from lexweave.operators import latent


def test_axes_are_those_of_the_matrix(spark):
    r = np.random.default_rng(3)
    matrix = r.poisson(0.4, (30, 25)).astype(float)
    matrix[:10, :6] += r.poisson(4, (10, 6))
    matrix[10:20, 6:12] += r.poisson(3, (10, 6))
    matrix[29] = 0
    cells = [(int(d), f"t{t:02d}", int(matrix[d, t])) for d, t in zip(*matrix.nonzero(), strict=True)]
    counts = spark.createDataFrame(cells, "doc_id long, term string, tf int")
    loadings, singular, shares = latent.axes(counts)
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(singular, s[:3], rtol=1e-6) and np.allclose(shares, s[:3] ** 2 / (matrix**2).sum(), rtol=1e-6) and sum(shares) <= 1
    own = {row.term: np.array(row[1:]) for row in loadings.collect()}
    for axis in range(3):
        vector = np.array([own.get(f"t{t:02d}", np.zeros(3))[axis] for t in range(25)])
        assert np.isclose(abs(vector @ v[axis]), 1, atol=1e-5) and vector[np.argmax(np.round(np.abs(vector), 9))] > 0
    places = {row.doc_id: np.array(row[1:]) for row in latent.folded(counts, loadings).collect()}
    assert set(places) == {d for d, *_ in cells}
    assert np.allclose([abs(places[d]) for d in sorted(places)], abs(u[:29, :3] * s[:3])[sorted(places)], atol=1e-4)
    new = latent.folded(spark.createDataFrame([(99, t, n) for d, t, n in cells if d == 4] + [(98, "unseen", 3)], "doc_id long, term string, tf int"), loadings)
    got = {row.doc_id: np.array(row[1:]) for row in new.collect()}
    assert np.allclose(got[99], places[4]) and not got[98].any()


def test_axes_of_little(spark):
    loadings, singular, shares = latent.axes(spark.createDataFrame([(1, "a", 2), (2, "a", 1)], "doc_id long, term string, tf int"))
    assert np.allclose(singular, [5**0.5, 0, 0]) and np.allclose(shares, [1, 0, 0]) and np.allclose(loadings.first()[1:], [1, 0, 0])
    loadings, singular, shares = latent.axes(spark.createDataFrame([], "doc_id long, term string, tf int"))
    assert loadings.count() == 0 and not any(singular) and not any(shares)
