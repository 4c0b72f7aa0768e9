"""Toxicity by multiple-instance learning: a document is toxic where some sentence is.

A sentence's score is the logistic of a bias and the weights of its distinct words and word beginnings that the model knows; one
without any has a bias of its own, so that a long clean text does not add up to a toxic one. A document's score is the noisy-or of all
its sentences, 1 - prod(1 - p). Words are chosen by their evidence, counted by a shuffled aggregate over a
bounded sample of labelled documents (`SAMPLE` a class, weighted back to the classes' sizes, texts up to `LARGEST` bytes); weights and
biases are fitted from document labels alone, by proximal gradient steps on the noisy-or likelihood. Scores are then made for every
whole text, and the sentences that carry them are located.

Null and empty texts count as one sentence without words; a very long one is all its sentences. Rows without a label are only scored.
Where no labelled row has one of the classes, every sentence has the share of the other, by an empty model. Equal evidence falls by
hash. Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import cut, documents, forget, map_batches
from lexweave.llm.labelled import held_out, sample

#: Labelled documents of a class that are fitted to, words that a model keeps.
SAMPLE, WORDS = 2000, 1 << 16
CUTOFF = 0.7
_END = re.compile(r"[.!?\n]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words whose features a task remembers, some 10 MB; those the model has nothing of share one empty answer.
_REMEMBERED = 1 << 16
_NOTHING: dict[int, float] = {}


class Model(NamedTuple):
    bias: float  # of sentences with a known word
    weights: dict[int, float]  # by hash, of features()
    clean: float  # logit of a sentence without one


def features(word: str) -> list[int]:
    """Hashes of a word without its edge punctuation, and of its beginnings of 4 to 8 characters that go on: stems take many endings."""
    word = word.strip(_EDGE).lower()
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:k]}+".encode()) for k in range(4, min(len(word), 9)))]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each stretch between sentence ends that holds anything but white space; (0, 0) where there is none."""
    out, start, text = [], 0, text or ""
    for end in _END.finditer(text):
        if not text[start : end.start()].isspace() and start < end.start():
            out.append((start, end.start()))
        start = end.end()
    if start < len(text) and not text[start:].isspace():
        out.append((start, len(text)))
    return out or [(0, 0)]


def _evidence(both: np.ndarray, with_word: np.ndarray, positives: int, whole: int) -> np.ndarray:
    """Twice the log-likelihood ratio of word against label; 0 where the word is no commoner in positive documents."""
    out = np.zeros(len(both))
    for seen, of, by in ((both, with_word, positives), (with_word - both, with_word, whole - positives), (positives - both, whole - with_word, positives), (whole - with_word - positives + both, whole - with_word, whole - positives)):
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) * whole / np.maximum(of * by, 1e-9))
    return np.where(both * whole > with_word * positives, out, 0.0)


def fit(examples: list[tuple[float, int, int, list[np.ndarray]]], hashes: np.ndarray, steps: int = 400, rate: float = 0.1, sparse: float = 0.02) -> Model:
    """A model of the words `hashes` from (weight, label, number of sentences without such a word, places in `hashes` of each other
    sentence's words). sparse: the L1 penalty in documents' worth."""
    whole = sum(w for w, *_ in examples)
    if len({y for _, y, *_ in examples}) < 2:
        share = sum(w * y for w, y, *_ in examples) / whole if whole else 0.5
        logit = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(logit, {}, logit)
    parts = [(d, at) for d, (*_, own) in enumerate(examples) for at in own]
    doc = np.fromiter((d for d, _ in parts), np.int64, len(parts))
    column = np.concatenate([at for _, at in parts]) if parts else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(at) for _, at in parts])
    weight = np.array([w for w, *_ in examples]) / whole
    y = np.array([y for _, y, *_ in examples], bool)
    without = np.array([n for _, _, n, _ in examples], np.float64)
    theta, biases = np.zeros(len(hashes)), np.array([-6.0, -9.0])  # of sentences with a known word, and without
    first, second = np.zeros(len(hashes) + 2), np.zeros(len(hashes) + 2)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p, q = logistic(biases[0] + np.bincount(row, theta[column], len(doc))), logistic(biases[1])
        clean = np.exp(np.bincount(doc, np.log1p(-p), len(y)) + without * np.log1p(-q))  # the probability that no sentence is toxic
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-12), 1.0) * weight
        slope = pull[doc] * p
        g = np.r_[np.bincount(column, slope[row], len(theta)), slope.sum(), (pull * without).sum() * q]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        biases = biases - move[-2:]
        theta = theta - move[:-2]
        shrink = sparse / whole * rate / (np.sqrt(second[:-2] / (1 - 0.999**step)) + 1e-8)
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - np.minimum(shrink, 0.5))
    used = np.flatnonzero(theta)
    return Model(float(biases[0]), dict(zip(hashes[used].tolist(), theta[used].tolist(), strict=True)), float(biases[1]))


def known_words(examples: DataFrame, positives: int, whole: int) -> np.ndarray:
    """Hashes, in order, of at most WORDS features of the examples (text, y) with more evidence than the likeliest of as many chance
    ones has; their documents are counted in Spark."""

    def make():
        def run(batch):
            found = [(f, y) for text, y in zip(batch["text"], batch["y"], strict=True) for f in {f for w in (text or "").split() for f in features(w)}]
            return {"feature": [f for f, _ in found], "y": [y for _, y in found]}

        return run

    counted = map_batches(examples.select("text", "y"), make, "feature long, y int").groupBy("feature").agg(F.sum("y").alias("both"), F.count("*").alias("docs"))
    counted = cut(counted)
    least = 2 * np.log(counted.count() + 1) + 4

    def evident(batches):
        for batch in batches:
            both, docs = (batch.column(i).to_numpy().astype(np.float64) for i in (1, 2))
            yield pa.RecordBatch.from_pydict({"feature": batch.column(0), "evidence": _evidence(both, docs, positives, whole)})

    kept = counted.mapInArrow(evident, "feature long, evidence double").where(F.col("evidence") >= float(least)).orderBy(F.desc("evidence"), "feature").limit(WORDS)
    return np.array(sorted(r.feature for r in kept.collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of a bounded sample. Texts are hashed on the executors; of each, its known words come to the driver, by sentence."""
    picked, counts = sample(docs, labels, "toxic", most)
    seen = {r.y: r["count"] for r in picked.groupBy("y").count().collect()}
    hashes = known_words(picked, seen.get(1, 0), sum(seen.values())) if len(seen) == 2 else np.empty(0, np.int64)

    def make():
        def run(batch):
            out = {"doc_id": batch["doc_id"], "y": batch["y"], "without": [], "sizes": [], "places": []}
            for text in batch["text"]:
                found = [np.intersect1d(hashes, np.array([f for w in (text or "")[a:b].split() for f in features(w)], np.int64), return_indices=True)[1] for a, b in sentences(text)]
                known = [at for at in found if len(at)]
                out["without"].append(len(found) - len(known))
                out["sizes"].append(np.array([len(at) for at in known], np.uint32).tobytes())
                out["places"].append(np.concatenate([*known, np.empty(0, np.int64)]).astype(np.uint32).tobytes())
            return out

        return run

    rows = map_batches(picked, make, "doc_id long, y int, without int, sizes binary, places binary").collect()
    examples = []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.y, r.without, bytes(r.places))):
        parts = np.split(np.frombuffer(r.places, np.uint32).astype(np.int64), np.cumsum(np.frombuffer(r.sizes, np.uint32))[:-1]) if r.sizes else []
        examples.append((max(1.0, counts[r.y] / max(1, most)), r.y, r.without, parts))
    return fit(examples, hashes)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def parts(self, word: str) -> dict[int, float]:
        """The features of a word that the model has."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            own = self.model.weights
            found = self.known[word] = own and {f: own[f] for f in features(word) if f in own} or _NOTHING
        return found

    def logits(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many sentences have no known word; start, end and logit of each other one."""
        out, without = [], 0
        for a, b in sentences(text):
            found: dict[int, float] = {}
            for word in (text or "")[a:b].split():
                if parts := self.parts(word):
                    found.update(parts)
            if found:
                out.append((a, b, self.model.bias + sum(found.values())))
            else:
                without += 1
        return without, out

    def judged(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text; start, end and score of each sentence with at least `least`."""
        without, found = self.logits(text)
        z = np.array([z for _, _, z in found])
        clean = np.logaddexp(0, z).sum() + without * np.logaddexp(0, self.model.clean)
        p = 1 / (1 + np.exp(-z))
        located = [(a, b, float(x)) for (a, b, _), x in zip(found, p, strict=True) if x >= least]
        if without and self.model.clean >= np.log(least / (1 - least)):  # an empty model of toxic documents only
            known, share = {(a, b) for a, b, _ in found}, float(1 / (1 + np.exp(-self.model.clean)))
            located = sorted(located + [(a, b, share) for a, b in sentences(text) if (a, b) not in known])
        return float(-np.expm1(-clean)), located

    def score(self, text: str | None) -> float:
        return self.judged(text)[0]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text, and the sentences that carry it: start:end of each that is toxic rather than not."""

    def make():
        own = Scorer(model)

        def run(batch):
            found = [own.judged(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "score": [s for s, _ in found], "offending": [",".join(f"{a}:{b}" for a, b, _ in x) for _, x in found]}

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, offending string")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of each sentence with at least that score."""

    def make():
        own = Scorer(model)

        def run(batch):
            out = {k: [] for k in ("doc_id", "start", "end", "sentence", "score")}
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                for a, b, p in own.judged(text, least)[1]:
                    for k, v in zip(out, (i, a, b, (text or "")[a:b], p), strict=True):
                        out[k].append(v)
            return out

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, start int, end int, sentence string, score double")


def without_toxic(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs whose score stays below the cutoff, with their columns: the text is scored beside them, in one pass."""
    schema = docs.schema

    def run(batches):
        forget(__name__)
        own = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))  # each becomes a string only while it is scored
            yield batch.filter(pa.array([own.score(t.as_py()) < cutoff for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = score_documents(docs, model)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "offending")
