"""Latent semantic axes of the document by term matrix, without holding it anywhere: subspace iteration over the stored counts.

A few directions in term space, a row a term, are turned by A'A: counts joined with the directions give each document a place, places joined
back give each term a new direction. After each turn the directions are made orthonormal by their small matrix of scalar products, which is
all that the driver sees. At the end the axes are told apart by the same kind of matrix. An axis points to where its term of the
largest loading, to nine places, is positive; among equals the term decides.

Any document or query that comes later is folded in by joining its terms with the stored loadings; a document of the collection gets its own
place. The share that an axis explains is its squared singular value over the sum of all squared counts.
Fewer independent documents or terms than axes give axes with a singular value of 0 and no loadings. An empty index has no axes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.sources.folders import checkpointed

AXES, SPARE, TURNS, STILL = 3, 5, 40, 1e-10


def _columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def _sums(names: list[str], weight: Column) -> list[Column]:
    return [F.sum(weight * F.col(c)).alias(c) for c in names]


def _products(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The matrix of scalar products of columns, a few numbers."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = found[f"p{i}_{j}"] or 0.0
    return out


def _mixed(rows: DataFrame, key: str, names: list[str], by: np.ndarray) -> DataFrame:
    """Columns c0, c1, ... as sums of the columns, weighted by the columns of a small matrix."""
    return rows.select(key, *(sum(float(by[i, k]) * F.col(c) for i, c in enumerate(names)).alias(f"c{k}") for k in range(by.shape[1])))


def _orthonormal(rows: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Rows (term, columns) with orthonormal columns, and the roots of what they were turned from, largest first."""
    values, vectors = np.linalg.eigh(_products(rows, names))
    values, vectors = values[::-1], vectors[:, ::-1]
    scale = np.where(values > 1e-12 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _mixed(rows, "term", names, vectors * scale), np.sqrt(np.maximum(values, 0))


def axes(counts: DataFrame, count: int = AXES) -> tuple[DataFrame, list[float], list[float]]:
    """Loadings (term, c0, c1, ...), singular values and explained shares of counts (doc_id, term, tf)."""
    names = _columns(count + SPARE)
    total = counts.agg(F.sum(F.col("tf") * F.col("tf")).alias("s")).first().s or 0
    start = [(F.hash("term", F.lit(i)) / float(1 << 31)).alias(c) for i, c in enumerate(names)]
    basis, size = _orthonormal(counts.select("term").distinct().select("term", *start), names)
    basis, before = checkpointed(basis), None
    for _ in range(TURNS if total else 0):
        places = counts.join(basis, "term").groupBy("doc_id").agg(*_sums(names, F.col("tf")))
        turned = checkpointed(counts.join(places, "doc_id").groupBy("term").agg(*_sums(names, F.col("tf"))))
        basis, size = _orthonormal(turned, names)
        basis = checkpointed(basis)
        if before is not None and np.abs(size - before)[:count].max() <= STILL * size[0]:
            break
        before = size
    places = counts.join(basis, "term").groupBy("doc_id").agg(*_sums(names, F.col("tf")))
    values, vectors = np.linalg.eigh(_products(places, names))
    values, vectors = np.maximum(values[::-1][:count], 0), vectors[:, ::-1][:, :count]
    loadings = _mixed(basis, "term", names, vectors * (values > 1e-12 * max(values[0], 1e-300)))
    own = _columns(count)
    signs = loadings.agg(*(F.max_by(F.signum(c), F.struct(F.round(F.abs(c), 9), "term")).alias(c) for c in own)).first()
    loadings = loadings.select("term", *((F.col(c) * float(-1 if (signs[c] or 0) < 0 else 1)).alias(c) for c in own))
    return checkpointed(loadings), [math.sqrt(v) for v in values], [v / total if total else 0.0 for v in values]


def folded(counts: DataFrame, loadings: DataFrame) -> DataFrame:
    """doc_id and its place on each axis, from counts (doc_id, term, tf); terms without loadings count for nothing."""
    names = [c for c in loadings.columns if c != "term"]
    found = counts.join(loadings, "term", "left").groupBy("doc_id").agg(*(F.coalesce(F.sum(F.col("tf") * F.col(c)), F.lit(0.0)).alias(c) for c in names))
    return found
