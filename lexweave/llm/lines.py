"""Quality rules and line labelling: a linear-chain conditional random field marks each line as content or boilerplate, and the share of a
text's words that stand in content lines decides whether it is kept.

No line is labelled anywhere; labels say whether a document is good. So the field is trained on documents: a good one has only content
lines, a bad one at least one boilerplate line. The loss of a good document is -log p(all content), that of a bad one -log(1 - p(all
content)), both exact by the forward algorithm, their gradients by forward-backward; which lines of a bad document are at fault is left to
the field. Decoding is Viterbi over all lines of the whole text.

The sample is bounded: `SAMPLE` documents a class, of `labelled.LARGEST` bytes and `LINES` lines at most; only numbers of lines go to the
driver, 4 * FEATURES * LINES bytes a document at most, never texts. What is labelled is every line of every text.

Null texts have no words: zeros, failed, not kept, as are all texts of less than ten words. Lines without a word are not labelled.
A text of one very long line is one line. Without labels of both classes all lines are content, and the base rules alone decide. Ties in
the decoding fall to content. Repeated rows get equal results; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import documents, map_batches
from lexweave.llm.labelled import held_out, sample

SAMPLE, LINES = 1500, 400
WINDOW, FEWEST, REPEATED_PERCENT = 5, 10, 20
#: Share of words in content lines from which a text is kept.
KEEP = 0.5
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
OTHER, SPACE, SYMBOL, UPPER, LOWER, DIGIT, MARK, SHOUT = range(8)
#: The kind of each byte. Bytes of other letters count as lower case.
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((SPACE, SPACES), (SYMBOL, SYMBOLS), (UPPER, range(65, 91)), (LOWER, [*range(97, 123), *range(128, 256)]), (DIGIT, range(48, 58)), (MARK, b".,;:?"), (SHOUT, b"!")):
    KINDS[list(_bytes)] = _kind
FEATURES = 15


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that are in the text twice or more. Windows are ranked by twos and fours, so that equal ranks are equal words."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    one = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    two = rank(one[:-1], one[1:])
    four = rank(two[:-2], two[2:])
    whole, times = np.unique(four[:n] * len(known) + one[4:], return_inverse=True, return_counts=True)[1:]
    starts = np.flatnonzero(times[whole] > 1)
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts, append=starts[-1] + WINDOW), WINDOW).sum())


class Read(NamedTuple):
    """A text's base counts and its lines: features, words and places (code points, end exclusive) of those with a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    words: np.ndarray
    lines: list[bytes]
    at: list[int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < FEWEST or 100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words


def read(text: str | None) -> Read:
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    numbered = [(i, line) for i, line in enumerate(data.split(b"\n")) if line.strip()]
    lines = [line for _, line in numbered]
    repeated = repeated_words(words)
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    features, held = line_features(lines, repeated / max(1, len(words)))
    return Read(len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, features, held, lines, [i for i, _ in numbered])


def line_features(lines: list[bytes], repeated: float) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and its number of words."""
    n = len(lines)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64)
    kind = KINDS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    size = np.array([len(line) + 1 for line in lines])
    line = np.repeat(np.arange(n), size)
    count = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    word_end = np.flatnonzero((kind[:-1] != SPACE) & (kind[1:] == SPACE))
    words = np.bincount(line[word_end], minlength=n)
    filled, letters = count.sum(1) - count[:, SPACE], count[:, UPPER] + count[:, LOWER]
    times: dict[bytes, int] = {}
    earlier = []
    for x in lines:
        earlier.append(times.get(x, 0))
        times[x] = earlier[-1] + 1
    bare = [x.strip() for x in lines]
    columns = [
        np.ones(n),
        count[:, UPPER] / np.maximum(letters, 1),
        np.minimum(count[:, SYMBOL] / words, 2) / 2,
        count[:, SYMBOL] / filled,
        count[:, DIGIT] / filled,
        np.minimum(count[:, SHOUT] / words, 2) / 2,
        np.minimum(count[:, MARK] / words, 2) / 2,
        count[:, OTHER] / filled,
        np.minimum(filled / words, 20) / 10,
        np.log1p(words) / 5,
        np.array([x[-1:] in b".?!" for x in bare], float),
        np.array([x[:1].isupper() or x[:1] >= b"\x80" for x in bare], float),
        np.minimum(earlier, 1),
        np.array([times[x] > 1 for x in lines], float),
        np.full(n, repeated),
    ]
    return np.stack(columns, axis=1), words


class Field(NamedTuple):
    """Weights of a line's features for boilerplate against content, and of two neighbours' labels (0 content, 1 boilerplate)."""

    line: np.ndarray
    step: np.ndarray


#: All lines are content.
OPEN = Field(np.array([-1.0] + [0.0] * (FEATURES - 1)), np.zeros((2, 2)))


def decode(field: Field, features: np.ndarray) -> list[int]:
    """The most likely labels, by Viterbi; ties fall to content."""
    (cc, cb), (bc, bb) = field.step.tolist()
    content, boiler, came = 0.0, 0.0, []
    for i, e in enumerate((features @ field.line).tolist()):
        if i:
            to_c, to_b = boiler + bc > content + cc, boiler + bb > content + cb
            content, boiler = (boiler + bc if to_c else content + cc), (boiler + bb if to_b else content + cb)
            came.append((to_c, to_b))
        boiler += e
    if not len(features):
        return []
    labels = [int(boiler > content)]
    for step in reversed(came):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


class Chains:
    """Documents' lines padded to one length, longest first, for sums over all of them line by line."""

    def __init__(self, features: list[np.ndarray]):
        self.order = sorted(range(len(features)), key=lambda i: -len(features[i]))
        own = [features[i] for i in self.order]
        self.sizes = np.array([len(x) for x in own])
        self.x = np.zeros((len(own), self.sizes[0], FEATURES))
        for i, x in enumerate(own):
            self.x[i, : len(x)] = x
        self.there = np.arange(self.sizes[0])[None] < self.sizes[:, None]
        self.open = self.there.sum(0)

    def moments(self, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log p(all content) of each document, and what it grows by with each line weight and with each step weight."""
        emit = np.zeros((*self.there.shape, 2))
        emit[:, :, 1] = self.x @ field.line
        n, length = self.there.shape
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, length):
            k = self.open[t]
            alpha[:k, t] = np.logaddexp.reduce(alpha[:k, t - 1, :, None] + field.step, axis=1) + emit[:k, t]
        for t in range(length - 2, -1, -1):
            k = self.open[t + 1]
            beta[:k, t] = np.logaddexp.reduce(field.step + (emit[:k, t + 1] + beta[:k, t + 1])[:, None], axis=2)
        log_z = np.logaddexp.reduce(alpha[np.arange(n), self.sizes - 1], axis=1)
        boiler = np.where(self.there, np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]), 0)
        both = alpha[:, :-1, :, None] + field.step + (emit[:, 1:] + beta[:, 1:])[:, :, None] - log_z[:, None, None, None]
        steps = np.where(self.there[:, 1:, None, None], np.exp(both), 0).sum(1)
        by_step = -steps
        by_step[:, 0, 0] += self.sizes - 1
        return field.step[0, 0] * (self.sizes - 1) - log_z, -np.einsum("nl,nlf->nf", boiler, self.x), by_step


def fit(features: list[np.ndarray], good: list[int], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """The field that makes good documents all content and bad ones not, both classes with equal weight, by Adam steps."""
    chains = Chains(features)
    y = np.array(good, float)[chains.order]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, m, v = np.zeros(FEATURES + 4), 0.0, 0.0
    for t in range(1, rounds + 1):
        log_p, by_line, by_step = chains.moments(Field(w[:FEATURES], w[FEATURES:].reshape(2, 2)))
        p = np.exp(np.minimum(log_p, -1e-9))
        pull = weight * np.where(y == 1, 1.0, -p / (1 - p))  # how much log p(all content) should grow
        grad = -np.concatenate([pull @ by_line, (pull[:, None, None] * by_step).sum(0).ravel()]) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(w[:FEATURES], w[FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    """A field fitted to a bounded sample of labelled documents outside the held-out fold."""
    picked, _ = sample(docs, labels, "quality", most)

    def make():
        def run(batch):
            found = [read(t).features for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "y": batch["y"], "n": [len(x) for x in found], "x": [x[:LINES].astype("<f4").tobytes() for x in found]}

        return run

    rows = map_batches(picked, make, "doc_id long, y int, n int, x binary").where(F.col("n").between(1, LINES)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    if len({r.y for r in rows}) < 2:
        return OPEN
    return fit([np.frombuffer(r.x, "<f4").reshape(r.n, FEATURES).astype(float) for r in rows], [r.y for r in rows])


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and lines: for each line with a word its number in the text, its words, and whether it is content."""

    def make():
        def run(batch):
            found = [read(t) for t in batch["text"]]
            lines = [[{"line": i, "words": n, "content": not b} for i, n, b in zip(x.at, x.words.tolist(), decode(field, x.features), strict=True)] for x in found]
            return {"doc_id": batch["doc_id"], "lines": lines}

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lines array<struct<line: int, words: int, content: boolean>>")


def judge(docs: DataFrame, field: Field, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of every whole text."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

    def make():
        def run(batch):
            out = {"doc_id": batch["doc_id"]} | {k: [] for k in (*base, "content_share", "kept")}
            for text in batch["text"]:
                x = read(text)
                share = float(x.words @ (1 - np.array(decode(field, x.features)))) / x.n_words if x.n_words else 0.0
                for k in base:
                    out[k].append(getattr(x, k))
                out["content_share"].append(share)
                out["kept"].append(not x.base_failed and share >= keep)
            return out

        return run

    longs = ", ".join(f"{k} long" for k in base[:-1])
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id long, {longs}, base_failed boolean, content_share double, kept boolean")


def op11_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.withColumn("held_out", held_out(F.col("doc_id")))
