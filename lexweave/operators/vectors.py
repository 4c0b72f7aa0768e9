"""Nearest vectors: by an inverted file of cells, and exactly, block against block.

Vectors are compared by cosine. `exact` compares a stated set of queries with all rows, packed in blocks, one matrix product a pair of
blocks, each of which gives its best few. `VectorIndex` fits centroids on a bounded sample, assigns every row to its nearest one, and searches the
cells nearest to a query; how many is calibrated on a sample of the rows as queries, whose true neighbours `exact` finds. A cell with
many rows is dealt to several tasks, and so are many queries of a cell, so that no group grows with the data.

Vectors that are null, empty, zero or hold null or non-finite numbers are in no result and as queries find nothing; vectors of another
length than the centroids likewise. A query doesn't find its own id. Ties fall to the smaller id. Scores are compared rounded to nine
places. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.sources.folders import create, delete, read_text

#: Rows whose vectors the centroids are fitted on, rounds of fitting, and how many cells there are at most.
SAMPLE, ROUNDS, CELLS = 20_000, 12, 1024
#: Rows and queries of a cell that one task compares.
DEALT, ASKED = 8192, 4096
BLOCK = 2048
#: Bytes of queries that are broadcast to all rows; beyond, every one of some shares of the rows, SHARES a core, gets them by shuffle.
SENT, SHARES = 32 << 20, 4
#: Queries that the number of probed cells is calibrated on, and the recall asked for.
CALIBRATED, RECALL = 128, 0.97

FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
FOUND_SQL = "query_id long, doc_id long, score double"


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1; None where it has no direction."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / math.sqrt(v @ v)


def units(vectors: DataFrame) -> DataFrame:
    """doc_id, v: rows (doc_id, v array) that have a direction, at length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, u) for i, v in zip(b["doc_id"].to_pylist(), b["v"].to_pylist(), strict=True) if i is not None and (u := unit(v)) is not None]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in found], pa.int64()), "v": pa.array([u for _, u in found], pa.list_(pa.float64()))})

    return vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "v").mapInArrow(run, "doc_id long, v array<double>")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k rows of each query but for its own id."""
    out: dict[str, list] = {"query_id": [], "doc_id": [], "score": []}
    for at in range(0, len(queries), 512):
        scores = np.round(queries[at : at + 512] @ rows.T, 12)
        for q, own in zip(query_ids[at : at + 512], scores, strict=True):
            own = np.where(ids == q, -np.inf, own)
            some = np.flatnonzero(np.round(own, 9) >= np.round(np.partition(own, -k)[-k], 9)) if len(own) > k else np.arange(len(own))
            for j in sorted(some, key=lambda j: (-round(own[j], 9), ids[j]))[:k]:
                if own[j] > -np.inf:
                    out["query_id"].append(q)
                    out["doc_id"].append(ids[j])
                    out["score"].append(own[j])
    return pa.RecordBatch.from_pydict(out, schema=FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of what parts have given."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def packed(vectors: DataFrame, prefix: str) -> DataFrame:
    """Rows of up to BLOCK unit vectors each: ids, their numbers in one row, and their length; vectors of one length together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        pack = lambda dim, rows: pa.RecordBatch.from_pydict({f"{prefix}_ids": [[i for i, _ in rows]], f"{prefix}_v": [np.concatenate([v for _, v in rows])], f"{prefix}_dim": pa.array([dim], pa.int32())})
        for b in batches:
            for i, v in zip(b["doc_id"].to_pylist(), b["v"].to_pylist(), strict=True):
                own = waiting.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == BLOCK:
                    yield pack(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield pack(dim, rows)

    return units(vectors).mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_v array<double>, {prefix}_dim int")


def exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank from queries and vectors (doc_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield top(np.array(r["q_ids"]), np.array(r["q_v"]).reshape(-1, r["q_dim"]), np.array(r["x_ids"]), np.array(r["x_v"]).reshape(-1, r["x_dim"]), k)

    asked, rows = packed(queries, "q"), packed(vectors, "x")
    size = queries.agg(F.sum(F.coalesce(F.size("v"), F.lit(0))).alias("n")).first().n or 0
    if 8 * size <= SENT:
        blocks = rows.join(F.broadcast(asked), F.col("q_dim") == F.col("x_dim"))
    else:  # each share of the rows gets all queries
        shares = asked.sparkSession.sparkContext.defaultParallelism * SHARES
        asked = asked.withColumn("q_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        rows = rows.withColumn("x_share", F.pmod(F.xxhash64("x_ids"), F.lit(shares)).cast("int"))
        blocks = rows.join(asked, (F.col("q_dim") == F.col("x_dim")) & (F.col("q_share") == F.col("x_share")))
    return best(blocks.mapInArrow(run, FOUND_SQL), k)


def exact_within(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank where a query is compared with the rows of its own set only, from queries and vectors (pair, doc_id, v).
    A set's rows are dealt to shares of DEALT, and its queries go to each of them."""
    large = vectors.groupBy("pair").count().select("pair", F.ceil(F.col("count") / DEALT).cast("int").alias("shares"))
    of = lambda df: df.join(units(df.select("doc_id", "v")).dropDuplicates(["doc_id"]).withColumnRenamed("v", "u"), "doc_id").select("pair", "doc_id", F.col("u").alias("v"))
    rows = of(vectors).join(large, "pair").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")).drop("shares")
    asked = of(queries).join(large.withColumnRenamed("pair", "in_pair"), F.col("pair") == F.col("in_pair"))
    asked = asked.withColumn("in_share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("in_pair", "in_share", F.col("doc_id").alias("query_id"), F.col("v").alias("q"))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        parts = []
        for dim in {len(v) for v in q["q"]} & {len(v) for v in x["v"]}:
            one, other = q.filter(pa.array([len(v) == dim for v in q["q"]])), x.filter(pa.array([len(v) == dim for v in x["v"]]))
            parts.append(top(one["query_id"].to_numpy(), matrix(one["q"]), other["doc_id"].to_numpy(), matrix(other["v"]), k))
        return pa.Table.from_batches(parts, FOUND)

    return best(asked.groupBy("in_pair", "in_share").cogroup(rows.groupBy("pair", "share")).applyInArrow(run, FOUND_SQL), k)


def fitted(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows, by spherical k-means; a cell that loses all its rows is put on the row that fits its own cell worst."""
    chosen = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        near = rows @ chosen.T
        cell, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, cell, rows)
        size = np.sqrt((sums * sums).sum(1))
        for c, i in zip(np.flatnonzero(size < 1e-12), np.argsort(fit), strict=False):
            sums[c], size[c] = rows[i], 1.0
        chosen = sums / np.maximum(size, 1e-12)[:, None]
    return chosen


class VectorIndex:
    """A stored inverted file: `cells` holds (cell, part, doc_id, v), the manifest the centroids, cell sizes and the calibrated number
    of cells to probe."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        told = json.loads(read_text(spark, f"{path}/manifest"))
        self.centroids, self.sizes, self.probes, self.recall = np.array(told["centroids"], np.float64), told["sizes"], told["probes"], told["recall"]
        self.rows = spark.read.parquet(f"{path}/{told['cells']}")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 10, cells: int | None = None, recall: float = RECALL) -> VectorIndex:
        """From vectors (doc_id, v). k: as many neighbours as the probing is calibrated for."""
        spark, name = vectors.sparkSession, f"cells-{uuid.uuid4().hex}"
        known = units(vectors)
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()  # SAMPLE rows at most
        lengths = [len(r.v) for r in sample]
        dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
        rows = np.array([r.v for r in sample if len(r.v) == dim], np.float64) if sample else np.zeros((0, 0))
        count = cells or min(CELLS, max(1, round(math.sqrt(known.count()))))
        centroids = fitted(rows, count) if len(rows) else np.zeros((0, dim))
        assigned = cls._nearest(known, centroids, 1).select(F.col("cells")[0].alias("cell"), "doc_id", "v")
        sizes = {r.cell: r["count"] for r in assigned.groupBy("cell").count().collect()}  # a row for each cell
        parts = F.lit(1)
        if large := {c: n for c, n in sizes.items() if n > DEALT}:
            parts = F.coalesce(F.create_map(*(F.lit(x) for c, n in large.items() for x in (c, -(-n // DEALT))))[F.col("cell")], F.lit(1))
        dealt = assigned.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
        dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "doc_id").write.parquet(f"{path}/{name}")
        told = {"cells": name, "centroids": centroids.tolist(), "sizes": {str(c): n for c, n in sizes.items()}, "probes": 1, "recall": 1.0}
        delete(spark, f"{path}/manifest")
        create(spark, f"{path}/manifest", json.dumps(told))
        index = cls(spark, path)
        if len(rows):
            told["probes"], told["recall"] = index._calibrated(k, recall)
            delete(spark, f"{path}/manifest")
            create(spark, f"{path}/manifest", json.dumps(told))
        return cls(spark, path)

    @staticmethod
    def _nearest(known: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
        """doc_id, v and the nearest cells, nearest first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fits = pa.array([len(v) == centroids.shape[1] and len(centroids) > 0 for v in b["v"]], pa.bool_())
                b = b.filter(fits)
                cells = np.argsort(-(matrix(b["v"]) @ centroids.T), axis=1, kind="stable")[:, :most] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["v"], pa.array(list(cells), pa.list_(pa.int32()))], ["doc_id", "v", "cells"])

        return known.mapInArrow(run, "doc_id long, v array<double>, cells array<int>")

    def _calibrated(self, k: int, recall: float) -> tuple[int, float]:
        """The least number of cells whose recall on sampled rows is enough: each true neighbour's cell has a place in the order of its query's cells."""
        asked = self.rows.select("doc_id", "v").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(CALIBRATED)
        truth = exact(asked, self.rows.select("doc_id", "v"), k).select("query_id", "doc_id")
        where = truth.join(self.rows.select("doc_id", "cell"), "doc_id").select("query_id", "cell")
        order = self._nearest(asked, self.centroids, len(self.centroids)).select(F.col("doc_id").alias("query_id"), "cells")
        places = where.join(order, "query_id").select(F.array_position("cells", F.col("cell")).alias("place")).collect()  # CALIBRATED * k rows
        for probes in range(1, len(self.centroids) + 1):
            share = sum(r.place <= probes for r in places) / max(1, len(places))
            if share >= recall:
                return probes, share
        return len(self.centroids), 1.0

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank from queries (doc_id, v)."""
        if not len(self.centroids):
            return self.spark.createDataFrame([], f"{FOUND_SQL}, rank int")
        asked = self._nearest(units(queries), self.centroids, probes or self.probes)
        asked = asked.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.explode("cells").alias("in_cell"))
        large = {c: -(-n // DEALT) for c, n in self.sizes.items() if n > DEALT}
        parts = F.coalesce(F.create_map(*(F.lit(x) for c, n in large.items() for x in (int(c), n)))[F.col("in_cell")], F.lit(1)) if large else F.lit(1)
        asked = asked.withColumn("in_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        # many queries of a cell are dealt too, and the cell's rows copied to each share
        crowded = {r.in_cell: -(-r["count"] // ASKED) for r in asked.where("in_part = 0").groupBy("in_cell").count().where(F.col("count") > ASKED).collect()}  # a row for each cell at most
        shares = lambda cell: F.coalesce(F.create_map(*(F.lit(x) for c, n in crowded.items() for x in (c, n)))[F.col(cell)], F.lit(1)) if crowded else F.lit(1)
        asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), shares("in_cell")).cast("int"))
        rows = self.rows.withColumn("of_share", F.explode(F.sequence(F.lit(0), shares("cell") - 1)))

        def run(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return pa.Table.from_batches([], FOUND)
            return pa.Table.from_batches([top(q["query_id"].to_numpy(), matrix(q["q"]), x["doc_id"].to_numpy(), matrix(x["v"]), k)])

        found = asked.groupBy("in_cell", "in_part", "share").cogroup(rows.groupBy("cell", "part", "of_share")).applyInArrow(run, FOUND_SQL)
        return best(found, k)
