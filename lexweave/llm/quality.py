"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, serves a text better.

A bounded sample of labelled documents (`SAMPLE` a class, texts up to `LARGEST` bytes) is halved: from one half come the dictionaries,
of which at most `PIECES` blocks a document, spread over it, are brought to the driver; from the other the
calibration, a logistic fit of the normalised difference (bad - good) / (bad + good) of the compressed sizes, which the executors
measure. Texts are compressed whole, in blocks of `BLOCK` bytes, so that a dictionary helps in all of a long text as in a short one.

Null and empty texts compress to nothing: a difference of 0. Where a class has no labelled row every score is the share of the
other class. Equal hashes of ids fall by id. Repeated rows get equal scores; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import documents, map_batches
from lexweave.llm.labelled import held_out, sample

SAMPLE, BLOCK, DICTIONARY, LEVEL = 1500, 2048, 64 * 1024, 3
#: Blocks of a document that a dictionary is trained on: 2 * SAMPLE * PIECES * BLOCK bytes at most, 49 MB.
PIECES = 8
CUTOFF = 0.5


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def spread(parts: list[bytes], most: int) -> list[bytes]:
    """At most `most` of the parts, evenly spread."""
    return parts if len(parts) <= most else [parts[i * len(parts) // most] for i in range(most)]


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary. Of fewer than 16 blocks, or blocks of less than 8 kB, which the trainer refuses, one of raw content."""
    if len(parts) < 16 or sum(map(len, parts)) < 8192:
        return b"".join(spread(parts, DICTIONARY // BLOCK))
    return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, parts)) // 8)), parts, level=LEVEL).as_bytes()


class Compressors:
    def __init__(self, model: Model):
        self.pair = [self._open(d) for d in (model.good, model.bad)]

    @staticmethod
    def _open(data: bytes):
        if not data:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        parts = blocks(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.pair)
        return (bad - good) / (bad + good) if parts else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset by Newton steps; x in units of its deviation while fitting."""
    unit = float(x.std()) or 1.0
    design, w = np.stack([x / unit, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (weight * (p - y)) / weight.sum() + ridge * w
        h = (design * (weight * p * (1 - p) / weight.sum())[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-10:
            break
    return float(w[0] / unit), float(w[1])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    picked, counts = sample(docs, labels, "quality", most)
    picked = picked.select("doc_id", "y", "text", F.xxhash64("text").alias("key"))

    def make():
        return lambda batch: {c: batch[c] for c in ("doc_id", "y", "key")} | {"blocks": [spread(blocks(t), PIECES) for t in batch["text"]]}

    rows = map_batches(picked, make, "doc_id long, y int, key long, blocks array<binary>").collect()
    rows.sort(key=lambda r: (r.y, r.doc_id, r.key))
    if len({r.y for r in rows}) < 2:
        share = rows[0].y if rows else 0.5
        return Model(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    first, second = rows[::2], {(r.doc_id, r.y, r.key) for r in rows[1::2]}
    model = Model(*(dictionary([bytes(b) for r in first if r.y == y for b in r.blocks]) for y in (1, 0)), 1.0, 0.0)

    def measure():
        own = Compressors(model)
        return lambda batch: {c: batch[c] for c in ("doc_id", "y", "key")} | {"x": [own.difference(t) for t in batch["text"]]}

    found = map_batches(picked, measure, "doc_id long, y int, key long, x double").collect()
    found = sorted((r.doc_id, r.y, r.x) for r in found if (r.doc_id, r.y, r.key) in second)
    x, y = np.array([x for *_, x in found]), np.array([float(y) for _, y, _ in found])
    slope, offset = logistic(x, y, np.array([max(1.0, counts[k] / most) for _, k, _ in found]))
    return model._replace(slope=slope, offset=offset)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def make():
        own = Compressors(model)

        def run(batch):
            x = np.array([own.difference(t) for t in batch["text"]])
            return {"doc_id": batch["doc_id"], "score": (1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))).tolist()}

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = score_documents(docs, model)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
