"""Embedding near-dedup by collision-counting projections.

Vectors of a label are dealt to cells by the signs of a few random projections, in several tables, so that a pair at the threshold
shares a cell in one of them with probability `recall`. Within a cell the vectors are sorted along `LINES` further projections. Each
vector walks its window on each line and meets those that lie in it; pairs that met the recall-calibrated number of times are
verified by their cosine in double precision. A pair counts in the first table in which its codes agree, so that no
pairs are shuffled: tasks give sums of links and a spanning forest. Cells beyond `TILE` vectors are split into pairs of chunks, so
that no task grows with a cell and no vector is left out. Equal vectors of a label are one vector with a multiplicity, told by 64
bits of a hash; single-precision vectors travel as such.

Labels or vectors that are null, zero vectors and those with null or non-finite components link with nothing: n_links 0, their own
component, kept. Vectors of different lengths don't link; long ones need no more than a row. Ties don't arise; repeated rows are
equal vectors, and different vectors under one id are each compared: each row has the links of its own vector. A row with a null id
links, but names no component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import map_batches, written
from lexweave.llm.components import Forest, components

THRESHOLD, RECALL, LINES = 0.93, 0.98, 20
#: Vectors expected in a cell, and those compared at once.
CELL, TILE = 256, 1024
#: Half the width of a window, in units of the distance at the threshold.
REACH = 1.15
SEED = 20240229


def tables_for(rows: int, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL) -> tuple[int, int]:
    """Bits of a code and number of tables: two vectors at the threshold differ in a sign with probability angle/pi."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / cell)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def least_collisions(lines: int = LINES, reach: float = REACH, recall: float = 0.995) -> int:
    """The count that a pair at the threshold reaches with probability `recall`: its differences along the lines are normal."""
    p, tail = math.erf(reach / math.sqrt(2)), 0.0
    for count in range(lines, -1, -1):
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            return count
    return 0


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vec_id, label, node, narrow, vec, codes: node identifies label and components; all but vec_id null where nothing links."""

    def make():
        def run(batch):
            out = {k: [] for k in ("label", "node", "narrow", "vec", "codes")}
            for label, values in zip(batch["label"], batch["embedding"], strict=True):
                row = (None,) * 5
                if label is not None and values and None not in values:
                    v = np.array(values, np.float64) + 0.0
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        node = int.from_bytes(hashlib.blake2b(f"{label}:".encode() + v.tobytes(), digest_size=8).digest(), "big", signed=True)
                        planes = np.random.default_rng([SEED, len(v)]).standard_normal((tables * bits, len(v)))
                        signs = (planes @ (v / top) > 0).reshape(tables, bits)
                        with np.errstate(over="ignore"):
                            single = v.astype(np.float32)
                        narrow = bool((single == v).all())
                        row = (str(label), node, narrow, (single if narrow else v).tobytes(), (signs @ (1 << np.arange(bits))).tolist())
                for k, x in zip(out, row, strict=True):
                    out[k].append(x)
            return {"vec_id": batch["vec_id"]} | out

        return run

    return map_batches(vectors.select("vec_id", "label", "embedding"), make, "vec_id long, label string, node long, narrow boolean, vec binary, codes array<int>")


def collision_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float, lines: int = LINES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of unit vectors that meet on enough lines, before verification. On each line the vectors of `right` are sorted
    and each of `left` walks its window; what it meets there is counted by pair. Without `right`, the vectors of `left` meet each other:
    each walks forward only, and pairs (i, j) have i < j."""
    other = left if right is None else right
    directions = np.random.default_rng([SEED, 1, left.shape[1]]).standard_normal((left.shape[1], lines))
    reach = REACH * math.sqrt(2 - 2 * threshold)
    a, b = left @ directions, other @ directions
    met = np.zeros(len(left) * len(other), np.uint8)
    wide = np.int64 if len(met) > 1 << 30 else np.int32
    for i in range(lines):
        order = np.argsort(b[:, i], kind="stable").astype(wide)
        line = b[order, i]
        own = order if right is None else np.arange(len(left), dtype=wide)
        high = np.searchsorted(line, a[own, i] + reach, "right")
        low = np.arange(1, len(order) + 1) if right is None else np.searchsorted(line, a[own, i] - reach, "left")
        sizes = high - low
        starts = np.cumsum(sizes) - sizes
        walked = order[np.repeat((low - starts).astype(wide), sizes) + np.arange(sizes.sum(), dtype=wide)]
        walker = np.repeat(own, sizes)
        if right is None:
            walker, walked = np.minimum(walker, walked), np.maximum(walker, walked)
        met[walker * wide(len(other)) + walked] += 1  # a pair meets once a line
    return np.divmod(np.flatnonzero(met >= least_collisions(lines)), len(other))


def tile_links(tile: pd.DataFrame, table: int, one: int, two: int, threshold: float) -> pd.DataFrame:
    """Links between the chunks `one` and `two` of a cell: rows (a, n) with sums of links and rows (a, b) of a spanning forest."""
    ids, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
    vectors = [np.frombuffer(v, np.float32 if narrow else np.float64) for v, narrow in zip(tile["vec"], tile["narrow"], strict=True)]
    dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
    found_a, found_n, edges = [], [], []
    for dim in np.unique(dims):  # vectors of different lengths don't link
        same = np.flatnonzero(dims == dim)
        rows = same[tile["chunk"].to_numpy()[same] == one]
        others = rows if one == two else same[tile["chunk"].to_numpy()[same] == two]
        if not len(rows) or not len(others):
            continue
        raw = np.stack([vectors[i] for i in np.r_[rows, others]]).astype(np.float64)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        a, b = unit[: len(rows)], unit[len(rows) :]
        i, j = collision_pairs(a, None if one == two else b, threshold)
        codes = np.array(tile["codes"].tolist(), np.int64).reshape(len(tile), -1)
        new = ~(codes[rows[i], :table] == codes[others[j], :table]).any(axis=1)
        i, j = i[new], j[new]
        near = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        i, j = rows[i[near]], others[j[near]]
        found_a += [ids[i], ids[j]]
        found_n += [copies[j], copies[i]]
        forest = Forest(len(tile))
        edges += [(ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
    if not found_a or not len(np.concatenate(found_a)):
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    nodes, at = np.unique(np.concatenate(found_a), return_inverse=True)
    sums = np.bincount(at, np.concatenate(found_n)).astype(np.int64)
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": np.r_[nodes, e[:, 0]], "b": np.r_[nodes, e[:, 1]], "n": np.r_[sums, np.zeros(len(e), np.int64)]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, recall, cell)
    rows = written(coded(vectors, bits, tables), "vectors")
    first = [F.first(c).alias(c) for c in ("label", "narrow", "vec", "codes")]
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *first)
    reps = written(reps, "representatives")
    where = ["label", "table", "code"]
    dealt = reps.select("*", F.posexplode("codes").alias("table", "code"))
    sizes = reps.select("label", F.posexplode("codes").alias("table", "code")).groupBy(where).count().where("count > 1")
    dealt = dealt.join(sizes.select(*where, F.ceil(F.col("count") / tile).cast("int").alias("chunks")), where)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})

    def links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_links(pdf, key[1], key[3], key[4], threshold)

    found = dealt.select(*where, "one", "two", "chunk", "node", "copies", "narrow", "vec", "codes").groupBy(*where, "one", "two").applyInPandas(links, "a long, b long, n long")
    found = written(found, "links")
    sums = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = components(found.where("n = 0").select("a", "b"))
    placed = reps.select("node", "rep", "copies").join(sums, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = placed.join(least, "component").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, hop) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.hop),
c AS (SELECT node, min(hop) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
