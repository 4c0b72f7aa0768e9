"""Language-model scores by online logistic context mixing.

Tokens are words and one end for each text. A text is the bytes of its words, each closed by a blank, and a line feed for the end.

* Bytes. A byte is eight binary decisions. Each is predicted in several contexts - the last 1 to 5 bytes of the text, across blanks, and
  the word so far as those show it - by counts of zeros and ones in all training texts. The predictions are mixed in the logistic domain
  with weights that a gate picks by the contexts' confidence; weights are learned by second-order steps, each a pass over all training
  bytes, and an adaptive table over (partial byte, mixed prediction), filled in one more pass, refines the result.
* Repeats. Before a word is spelled, one decision tells whether it is the one that most often followed the two words before, by their
  hash, in the training texts. Its probability is that of all training places whose hash is as sure, in the logistic domain, and a bias.
* Words. A word that is not so told is a mixture of its frequency in training and its spelling.

The bias of a text's repeats starts at 0 and the weight of its frequencies at the share of training tokens whose word occurs elsewhere
too; both are updated along the text, `STRIDE` words at a time.
In a training text what a place itself adds to counts is left out, so that it says what the rest of the corpus makes of it. `score` is
the log10 probability of the whole text so coded, unseen words included, `spelled_score` that of its bytes alone. A text that occurs
twice has few bits a byte, one of its kind alone has many.

Texts are dealt to blocks by a hash. A block sends each distinct window of 6 bytes, hash of two words (with all its successors) and word
once to the task that gathers it, packed by hash range, and gets counts and scores back; what is gathered grows with the corpus, and
neither the driver nor any task holds all of it. How texts are dealt changes no score; within a part, hashes of two words are told apart
by 32 bits, and successors by 16.

Null and empty texts are an end alone; a very long text is a block of its own size. Ties between successors fall by hash. Without training
texts counts are 0 and predictions even; an empty table gives an empty result. Repeated rows are texts of their own; a null doc_id is
held in training as its remainder is not 2; columns other than doc_id and text are left aside.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import bucket_of, documents, removed, written

FOLDS, HELD_OUT = 7, 2
END = b"\n"
#: Bytes of context; WORD is the word so far.
WORD, REACH = 0, 5
ORDERS = (1, 2, 3, 4, 5, WORD)
LONG, SHORT = 4, 2
#: Confidences (counts of a context) that part the gates, for orders 5 and 3.
GATES_5, GATES_3 = (1, 3, 8, 32, 256), (4, 32, 256)
STEPS, PASSES = 33, 2
#: How often the predicted word was seen, to part the gates of repeats; each is parted by its share of all successors too.
SEEN = (1, 2, 3, 5, 9, 33)
NO_GATE = 3 * len(SEEN)
#: Words between updates, and the rates of the updates.
STRIDE, BIAS_RATE, WEIGHT_RATE = 16, 0.05, 0.02
#: Bytes of text in a block, and for a part of the windows, of the hashes of two words, of the words; windows and bytes treated at once.
BLOCK, WINDOWS, PAIRS, WORDS = 5_000_000, 10_000_000, 10_000_000, 40_000_000
PIECE, CHUNK = 50_000, 1_500_000
#: Natural log of a byte's probability for each step of the 16-bit numbers that blocks get back; waves in which hashes are answered.
LOG_STEP, WAVES = -112 / 65535, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Model(NamedTuple):
    weights: np.ndarray  # gates x (orders + 1)
    refined: np.ndarray  # 256 x STEPS


def mixed(key: np.ndarray) -> np.ndarray:
    key = key * _A
    return (key ^ (key >> np.uint64(29))) * _B


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


# Bytes


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + (b" " if words else b"") + END


def windows(streams: list[bytes]) -> np.ndarray:
    """Of all bytes of streams: the 5 bytes before and the byte. Before a text there are blanks."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    window = data.astype(np.uint64)
    for i in range(1, REACH + 1):
        window[i:] |= data[:-i].astype(np.uint64) << np.uint64(8 * i)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    starts = np.cumsum(sizes) - sizes
    for i in range(REACH):  # blanks instead of the end of the text before
        at = (starts + i)[sizes > i]
        window[at] = window[at] & np.uint64((1 << 8 * (i + 1)) - 1) | np.uint64(int.from_bytes(b" " * (REACH - i), "big") << 8 * (i + 1))
    return window


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def token_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A polynomial hash of each token's bytes. data: the bytes; starts: where tokens start."""
    sizes = np.diff(np.r_[starts, len(data)])
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max(initial=1)), _A)], dtype=np.uint64)
    return mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts))


def chunks(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def of_order(order: int, before: np.ndarray) -> np.ndarray:
    """The context of an order."""
    if order != WORD:
        return before & np.uint64((1 << 8 * order) - 1)
    key, inside = np.zeros_like(before), np.ones(len(before), bool)
    for i in range(REACH):
        byte = before >> np.uint64(8 * i) & np.uint64(255)
        inside &= byte != 32
        key |= np.where(inside, byte << np.uint64(8 * i), np.uint64(0))
    return key


def decisions(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of a byte: the node (a one and the bits so far) and the bit."""
    for k in range(8):
        yield ((1 << k) | (data.astype(np.int64) >> (8 - k))).astype(np.uint64), (data >> (7 - k)) & 1


def stretched(counts: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions with a bias, and the gate. own: occurrences of the bit to be left out of the counts."""
    out, sure = np.empty((len(bit), len(counts) + 1)), []
    for i, (n0, n1) in enumerate(counts):
        n0, n1 = n0 - own * (bit == 0), n1 - own * (bit == 1)
        out[:, i] = np.log((n1 + 0.02) / (n0 + 0.02))  # stretch((n1 + 0.02) / (n + 0.04))
        sure.append(n0 + n1)
    out[:, -1] = 0.3
    gate = np.searchsorted(GATES_5, sure[LONG], "right") * (len(GATES_3) + 1) + np.searchsorted(GATES_3, sure[SHORT], "right")
    return out, gate


def levels(context: np.ndarray, data: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For k from 0 to 8: the counts of the bytes in the same context whose first k bits are the same."""
    key = np.unique(context, return_inverse=True)[1].astype(np.int64) << 8 | data
    order, out = np.argsort(key, kind="stable"), []
    key, c = key[order], c[order]
    for k in range(9):
        node = key >> 8 - k
        of = np.cumsum(np.r_[0, node[1:] != node[:-1]])
        out.append(level := np.empty(len(key)))
        level[order] = np.bincount(of, c)[of]
    return out


def predicted(window: np.ndarray, c: np.ndarray, pairs: np.ndarray, leave: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, gate, bit and node of the windows' eight decisions. The windows hold all that share their last two bytes before.
    pairs: counts of (byte before, byte) of all windows. leave: leaves one occurrence of a window with any out."""
    data, before = (window & np.uint64(255)).astype(np.int64), window >> np.uint64(8)
    last = (before & np.uint64(255)).astype(np.int64)
    single = [pairs.reshape(256, 1 << k, -1).sum(2)[last, data >> 8 - k].astype(np.float64) for k in range(9)]
    tables = []
    for order in ORDERS:
        if order == 1:
            tables.append(single)
            continue
        found = levels(of_order(order, before), data, c)
        if order == WORD:  # at its start, and after one byte of it, a word has the context of that byte before
            short = (last == 32) | (before >> np.uint64(8) & np.uint64(255) == 32)
            found = [np.where(short, one, own) for one, own in zip(single, found, strict=True)]
        tables.append(found)
    own = ((c > 0) & leave).astype(np.float64)
    for k, (node, bit) in enumerate(decisions(data)):
        counts = []
        for table in tables:
            hit, rest = table[k + 1], table[k] - table[k + 1]
            counts.append((np.where(bit, rest, hit), np.where(bit, hit, rest)))
        yield (*stretched(counts, own, bit), bit, node)


def untrained() -> Model:
    gates = (len(GATES_5) + 1) * (len(GATES_3) + 1)
    weights = np.full((gates, len(ORDERS) + 1), 1 / len(ORDERS))
    steps = squash((np.arange(STEPS) * 24 / (STEPS - 1)) - 12)
    return Model(weights, np.tile(steps, (256, 1)))


def mix(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(squash(np.einsum("ij,ij->i", x, weights[gate])), 1e-6, 1 - 1e-6)


def refine(model: Model, node: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The mean of the mixed prediction and the refined one, between the two nearest steps."""
    z = np.clip((stretch(p) + 12) * (STEPS - 1) / 24, 0, STEPS - 1.001)
    low = z.astype(np.int64)
    part, row = z - low, node.astype(np.int64)
    return np.clip((p + model.refined[row, low] * (1 - part) + model.refined[row, low + 1] * part) / 2, 1e-6, 1 - 1e-6)


def slopes(weights: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each gate: the loss, its slope and its curvature, in a row."""
    wide = x.shape[1]
    p, out = mix(x, gate, weights), np.zeros((len(weights), 1 + wide + wide * wide))
    loss, slope, curve = -weight * np.log(np.where(bit, p, 1 - p)), weight * (p - bit), weight * np.maximum(p * (1 - p), 1e-4)
    for g in np.unique(gate):
        at = gate == g
        part = x[at]
        out[g] = np.r_[loss[at].sum(), part.T @ slope[at], ((part * curve[at, None]).T @ part).ravel()]
    return out


def cells(model: Model, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, node: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often a cell of the refinement is met, and how often with a one."""
    z = np.clip((stretch(mix(x, gate, model.weights)) + 12) * (STEPS - 1) / 24, 0, STEPS - 1.001)
    cell = node.astype(np.int64) * STEPS + np.rint(z).astype(np.int64)
    return np.stack([np.bincount(cell, v, 256 * STEPS).reshape(256, STEPS) for v in (weight, weight * bit)])


def learned(model: Model, sums: Callable[[Callable], np.ndarray]) -> Model:
    """Mixing weights and refinement. sums(f) is the sum of f(x, gate, bit, node, weight) over all training decisions, one pass."""
    best, least, step = model.weights.copy(), np.full(len(model.weights), np.inf), np.zeros_like(model.weights)
    for _ in range(PASSES):
        now = best + step
        out = sums(lambda x, gate, bit, node, weight, now=now: slopes(now, x, gate, bit, weight))
        wide = now.shape[1]
        for g, row in enumerate(out):
            if row[0] < least[g]:
                least[g], best[g] = row[0], now[g]
                bent = row[1 + wide :].reshape(wide, wide)
                step[g] = -np.linalg.solve(bent + np.eye(wide) * (1e-7 * np.trace(bent) + 1e-9), row[1 : 1 + wide])
            else:
                step[g] /= 4
    model = model._replace(weights=best)
    seen, hits = sums(lambda x, gate, bit, node, weight: cells(model, x, gate, bit, node, weight))
    prior = max(1e-5 * seen.sum(), 1e-9)
    return model._replace(refined=(hits + prior * model.refined) / (seen + prior))


def pieces(window: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the windows of a part, those with the same two bytes before always together."""
    last = window >> np.uint64(8) & np.uint64(0xFFFF)
    order = np.argsort(last, kind="stable")
    start = 0
    for end in (*(np.flatnonzero(np.diff(last[order])) + 1), len(order)):
        if end - start >= PIECE or end == len(order):
            yield order[start:end]
            start = end


def byte_logs(window: np.ndarray, c: np.ndarray, pairs: np.ndarray, model: Model) -> np.ndarray:
    """Two rows: the natural log of the probability of each window's byte in training texts (one occurrence left out) and in others."""
    logs = np.zeros((2, len(window)))
    for at in pieces(window, c):
        for row, leave in enumerate((True, False)):
            for x, gate, bit, node in predicted(window[at], c[at], pairs, leave):
                p = refine(model, node, mix(x, gate, model.weights))
                logs[row, at] += np.log(np.where(bit, p, 1 - p))
    return logs


# Repeats


def successors(owner: np.ndarray, word: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (owner, word) in order and how often each is there. word: of 16 bits; times: how often each row counts, once if None."""
    key = owner.astype(np.uint64)
    key <<= np.uint64(16)
    key |= word.astype(np.uint16)
    if times is None:
        key, times = distinct(key)
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key, times = key[first], np.add.reduceat(times, first) if len(first) else times
    return (key >> np.uint64(16)).astype(np.int32), key.astype(np.uint16), times


def two_commonest(owner: np.ndarray, word: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner below `size` its two commonest words and their counts, (size, 2) each, of all its successors; ties fall to the smaller
    word. More are never needed: a place leaves out one occurrence of one word."""
    same = np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.empty(0, bool)
    several = np.flatnonzero(same | np.r_[False, same[:-1]])
    order = np.arange(len(owner))
    order[several] = several[np.lexsort((-times[several], owner[several]))]
    word, times = word[order], times[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else several
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    words, counts = np.zeros((size, 2), np.uint32), np.zeros((size, 2), np.int64)
    for k in (0, 1):
        at = place == k
        words[owner[at], k], counts[owner[at], k] = word[at], times[at]
    return words, counts


def gate_of(times: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gates of predictions seen `times` of `total`; NO_GATE where none was seen."""
    share = (2 * times > total).astype(np.int64) + (times == total)
    return np.where(times > 0, (np.searchsorted(SEEN, times, "right") - 1) * 3 + share, NO_GATE)


def foretold(word: np.ndarray, words: np.ndarray, counts: np.ndarray, total: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gate of the prediction at each place, and whether the word there is the one predicted. own: 1 in training texts, whose own
    occurrence is left out."""
    first = word == words[:, 0]
    times = counts[:, 0] - own * first
    other = times < counts[:, 1]
    gate = gate_of(np.where(other, counts[:, 1], times), total - own)
    return gate, np.where(other, (word == words[:, 1]) & (counts[:, 1] > own), first) & (gate != NO_GATE)


def hit_counts(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How many training places have each gate, and how many of them are hits: (2, NO_GATE + 1)."""
    n1, n2 = counts.T
    left = n1 - 1
    hit = left >= np.maximum(n2, 1)
    out = np.zeros((2, NO_GATE + 1))
    for gate, places, right in ((gate_of(np.where(left < n2, n2, left), total - 1), n1, hit * n1), (gate_of(n1, total - 1), total - n1, 0 * n1)):
        out[0] += np.bincount(gate, places, NO_GATE + 1)
        out[1] += np.bincount(gate, right, NO_GATE + 1)
    return out


# Blocks


class Block:
    """The texts of a block: their tokens, one after the other, and what is looked up for them."""

    def __init__(self, texts: list[str | None], held: np.ndarray):
        data = [(t or "").encode("utf-8") for t in texts]
        found = [d.lower().split() for d in data]
        self.streams = [stream(w) for w in found]
        self.held, self.sizes = held, np.fromiter(map(len, found), np.int64, len(found)) + 1
        self.raw = np.fromiter(map(len, data), np.int64, len(texts))
        self.text = np.repeat(np.arange(len(found)), self.sizes)
        self.word, self.bytes = np.empty(len(self.text), np.uint64), np.empty(len(self.text), np.int64)
        token = 0
        for part in chunks(self.streams):
            data = np.frombuffer(b"".join(self.streams[part]), np.uint8)
            starts = np.r_[0, np.flatnonzero((data == 32) | (data == END[0]))[:-1] + 1]
            own = slice(token, token := token + len(starts))
            self.word[own], self.bytes[own] = token_hashes(data, starts), np.diff(np.r_[starts, len(data)])
        self.own = (~held[self.text]).astype(np.int64)

    @functools.cached_property
    def windows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each chunk: the windows of its bytes, and whether they are of held-out texts."""
        out = []
        for part in chunks(self.streams):
            sizes = np.fromiter(map(len, self.streams[part]), np.int64)
            out.append((windows(self.streams[part]), np.repeat(self.held[part], sizes)))
        return out

    def distinct_windows(self) -> np.ndarray:
        return distinct(np.concatenate([distinct(window)[0] for window, _ in self.windows]))[0]

    def trained_windows(self, keys: np.ndarray) -> np.ndarray:
        """The counts of the distinct windows in training texts."""
        counts = np.zeros(len(keys), np.uint32)
        for window, out in self.windows:
            found, times = distinct(window[~out])
            counts[np.searchsorted(keys, found)] += times.astype(np.uint32)
        return counts

    def spelled(self, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The log probability of each token's bytes from those of the distinct windows."""
        hashes = mixed(keys)
        order = np.argsort(hashes)
        hashes, logs = hashes[order], logs[:, order]
        bits = max(1, int(len(keys)).bit_length())
        starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        out, token = np.zeros(len(self.word)), 0
        for part, (window, out_of) in zip(chunks(self.streams), self.windows, strict=True):
            key = mixed(window)
            at = starts[(key >> np.uint64(64 - bits)).astype(np.int64)]
            wrong = np.flatnonzero(hashes[at] != key)
            while len(wrong):
                at[wrong] += 1
                wrong = wrong[hashes[at[wrong]] != key[wrong]]
            row = out_of.astype(np.int64)
            n = int(self.sizes[part].sum())
            sizes = self.bytes[token : token + n]
            out[token : token + n] = np.add.reduceat(logs[row, at], np.cumsum(sizes) - sizes)
            token += n
        return out

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, which one each token is, and their counts in training texts."""
        keys, at = np.unique(self.word, return_inverse=True)
        return keys, at, np.bincount(at, self.own, len(keys)).astype(np.uint32)

    def followed(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct hashes of the two words before a token, which each token has, and all their successors in training texts."""
        first = np.r_[True, self.text[1:] != self.text[:-1]]
        before = np.where(first, np.uint64(1), np.r_[np.uint64(1), self.word[:-1]])
        second = np.where(first, np.uint64(2), np.r_[np.uint64(2), before[:-1]])
        keys, at = np.unique(mixed(before ^ mixed(second)), return_inverse=True)
        trained = self.own == 1
        return keys, at, successors(at[trained], self.word[trained] >> np.uint64(48))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the two words before a token, which each token has, their two commonest successors in training texts,
        the counts of those, and of all."""
        keys, at, after = self.followed()
        return keys, at, *two_commonest(*after, len(keys)), np.bincount(at, self.own, len(keys)).astype(np.int64)


def window_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last two bytes before, which all contexts but that of one byte share."""
    return (mixed(keys >> np.uint64(8) & np.uint64(0xFFFF)) >> np.uint64(40)).astype(np.int64) % parts


def hash_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(40)).astype(np.int64) % parts


def places(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places that are in it, in order."""
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[own[0]]), own


_BYTE = lambda x: np.minimum(x, 255).astype(np.uint8)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all first bytes first."""
    size = values.dtype.itemsize
    return values.reshape(-1).view(np.uint8).reshape(-1, size)[:, :width].T.tobytes()


def unplaned(data: bytes, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(kind)


def packed(c: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those of 255 or more once again."""
    return _BYTE(c).tobytes(), c[c >= 255].astype(np.uint32).tobytes()


def unpacked(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.uint32)
    return out


_SENT = "block long, kind int, part int, keys binary, words binary, counts binary, total binary"
_BACK = "block long, kind int, part int, words binary, counts binary, stats array<double>"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, spelled_score double, bits_per_byte double"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def blobs(table: pa.Table | pa.RecordBatch, name: str) -> list[bytes | None]:
    """The binary values of a column, which _table compresses."""
    expand = zstandard.ZstdDecompressor().decompress
    return [x if not x else expand(x) for x in table[name].to_pylist()]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, schema.split(", "))])
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    shrink = zstandard.ZstdCompressor(level=1).compress
    columns = [[x if not x else shrink(x) for x in c] if f.type == pa.binary() else c for c, f in zip(columns, arrow, strict=True)]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _block(texts: pa.Table) -> Block:
    return Block(texts["text"].to_pylist(), np.array(texts["held"].to_pylist(), bool))


def _sent(texts: pa.Table, parts: tuple[int, int, int]) -> pa.Table:
    """What a block sends: windows (kind 0), hashes of two words with all their successors (1), words (2), with counts, in the order of their
    keys by part."""
    own, number, rows = _block(texts), texts["block"][0].as_py(), []
    keys = own.distinct_windows()
    c = own.trained_windows(keys)
    for p, at in places(window_part(keys, parts[0])):
        rows.append((number, 0, p, planes(keys[at], REACH + 1), None, *packed(c[at])))
    keys, _, (owner, word, times) = own.followed()
    many, total = np.bincount(owner, minlength=len(keys)), np.bincount(owner, times, len(keys))
    starts = np.cumsum(many) - many
    for p, at in places(hash_part(keys, parts[1])):
        plain = total[at] == 1  # one word once, as most
        rest = at[~plain]
        n = many[rest]
        all_of = np.repeat(starts[rest] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        told = word[np.r_[starts[at[plain]], all_of]].astype(np.uint16).tobytes()
        small, large = packed(np.r_[n, times[all_of]])
        rows.append((number, 1, p, keys[at].astype(np.uint32).tobytes(), told, np.packbits(plain).tobytes() + small, large))
    keys, _, c = own.distinct_words()
    for p, at in places(hash_part(keys, parts[2])):
        rows.append((number, 2, p, keys[at].tobytes(), None, *packed(c[at])))
    return _table(rows, _SENT)


def _column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in blobs(table, name)]


def _windows_of(sent: pa.Table) -> list[np.ndarray]:
    return [unplaned(x, REACH + 1, np.uint64) for x in blobs(sent, "keys")]


def _counts_of(sent: pa.Table) -> np.ndarray:
    return np.concatenate([unpacked(a, b) for a, b in zip(blobs(sent, "counts"), blobs(sent, "total"), strict=True)])


def _gathered(sent: pa.Table) -> pa.Table:
    """The distinct windows of a part and their counts."""
    keys, at = np.unique(np.concatenate(_windows_of(sent)), return_inverse=True)
    c = np.bincount(at, _counts_of(sent), len(keys)).astype(np.int64)
    return _table([(sent["part"][0].as_py(), keys.tobytes(), c.tobytes())], "part int, keys binary, counts binary")


def _answered_windows(sent: pa.Table, gathered: pa.Table, pairs: np.ndarray, model: Model) -> pa.Table:
    """For each block of `sent`, the two log probabilities of its windows."""
    if not sent.num_rows:
        return _table([], _BACK)
    (keys,), (c,) = _column(gathered, "keys", np.uint64), _column(gathered, "counts", np.int64)
    logs = np.rint(byte_logs(keys, c, pairs, model) / LOG_STEP).astype(np.uint16)  # eight decisions of 1e-6 at least: above -111
    rows = []
    for block, part, own in zip(sent["block"].to_pylist(), sent["part"].to_pylist(), _windows_of(sent), strict=True):
        rows.append((block, 0, part, None, planes(logs[:, np.searchsorted(keys, own)], 2), None))
    return _table(rows, _BACK)


def _answered_pairs(sent: pa.Table) -> pa.Table:
    """For each block, where the corpus has seen more after its hashes than the block itself: the two commonest words, their counts and
    all. One more row has the hits by gate."""
    keys = _column(sent, "keys", np.uint32)
    ends = np.cumsum([0, *map(len, keys)])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    at = at.astype(np.int32)
    owners, words, counts, own = [], [], [], np.zeros(ends[-1], np.uint32)
    for i, (told, numbers, large) in enumerate(zip(*(blobs(sent, c) for c in ("words", "counts", "total")), strict=True)):
        size = ends[i + 1] - ends[i]
        plain = np.unpackbits(np.frombuffer(numbers, np.uint8, -(-size // 8)))[:size] > 0
        once, rest = ends[i] + np.flatnonzero(plain), ends[i] + np.flatnonzero(~plain)
        told, numbers = np.frombuffer(told, np.uint16), unpacked(numbers[-(-size // 8) :], large)
        entry = np.repeat(rest, numbers[: len(rest)])
        own[once], own[rest] = 1, np.bincount(entry - ends[i], numbers[len(rest) :], size)[rest - ends[i]]
        owners += [at[once], at[entry]]
        words.append(told)
        counts += [np.ones(len(once), np.uint32), numbers[len(rest) :].astype(np.uint32)]
    owners, words, counts = successors(*map(np.concatenate, (owners, words, counts)))
    words, counts = two_commonest(owners, words, counts.astype(np.int64), len(found))
    total = np.bincount(at, own, len(found)).astype(np.int64)
    rows = [(-1, 1, 0, None, None, hit_counts(counts, total).ravel().tolist())]
    for i, (block, part) in enumerate(zip(sent["block"].to_pylist(), sent["part"].to_pylist(), strict=True)):
        mine = at[ends[i] : ends[i + 1]]
        more = total[mine] > own[ends[i] : ends[i + 1]]
        mine = mine[more]
        numbers = np.stack([total[mine], *counts[mine].T]).astype(np.uint32)
        rows.append((block, 1, part, words[mine, 0].astype(np.uint16).tobytes() + words[mine[counts[mine, 1] > 0], 1].astype(np.uint16).tobytes(), np.packbits(more).tobytes() + planes(numbers, 4), None))
    return _table(rows, _BACK)


def _answered_words(sent: pa.Table) -> pa.Table:
    """For each block, the counts of its words. One more row has the sum of counts, how many words have any, and the sum of
    those above 1."""
    keys = _column(sent, "keys", np.uint64)
    ends = np.cumsum([0, *map(len, keys)])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(at, _counts_of(sent), len(found)).astype(np.int64)
    rows = [(-1, 2, 0, None, None, [float(c.sum()), float((c > 0).sum()), float(c[c > 1].sum())])]
    for i, (block, part) in enumerate(zip(sent["block"].to_pylist(), sent["part"].to_pylist(), strict=True)):
        rows.append((block, 2, part, None, planes(c[at[ends[i] : ends[i + 1]]], 8), None))
    return _table(rows, _BACK)


def coded(own: Block, gate: np.ndarray, hit: np.ndarray, chance: np.ndarray, frequency: np.ndarray, spelled: np.ndarray, known: float) -> np.ndarray:
    """The log probability of each text. The bias of its repeats and the weight of frequencies against spelling are updated along it;
    texts go side by side, STRIDE tokens at a time. chance: that of a hit by gate; frequency and spelled: of each token; known: the first
    weight of frequencies."""
    rows = -(-own.sizes // STRIDE)
    starts = np.cumsum(rows) - rows
    place = np.arange(len(own.word)) - np.repeat(np.cumsum(own.sizes) - own.sizes, own.sizes)
    at = (np.repeat(starts, own.sizes) * STRIDE + place).astype(np.int64)

    def laid(values: np.ndarray, rest: float) -> np.ndarray:
        out = np.full(int(rows.sum()) * STRIDE, rest, np.float32)
        out[at] = values
        return out.reshape(-1, STRIDE)

    there = laid(gate != NO_GATE, 0)
    z, y = laid(stretch(np.clip(chance, 1e-4, 1 - 1e-4))[gate], 0), laid(hit, 0)
    free = laid(1 - hit, 0)
    ratio = laid(np.clip(np.log(np.maximum(frequency, 1e-30)) - spelled, -60, 60), 0)
    spelled = laid(spelled, 0)
    bias, weight, out = np.zeros(len(rows)), np.full(len(rows), stretch(np.clip(known, 0.01, 0.99))), np.zeros(len(rows))
    order = np.argsort(-rows, kind="stable")
    alive = np.searchsorted(-rows[order], -np.arange(1, int(rows.max(initial=0)) + 1), "right")
    for step, n in enumerate(alive.tolist()):
        doc = order[:n]
        row = starts[doc] + step
        p = squash(z[row] + bias[doc, None])
        a = squash(weight[doc])[:, None]
        odds = np.exp(ratio[row])
        both = a * odds + (1 - a)
        out[doc] += (there[row] * np.log(np.where(y[row] > 0, p, 1 - p)) + free[row] * (spelled[row] + np.log(both))).sum(1)
        bias[doc] += BIAS_RATE * (there[row] * (y[row] - p)).sum(1)
        weight[doc] += WEIGHT_RATE * (free[row] * (a * odds / both - a)).sum(1)
    return out


def _scored(texts: pa.Table, back: pa.Table, parts: tuple[int, int, int], chance: np.ndarray, n: int, v: int, known: float) -> pa.Table:
    """The results of a block's texts from what came back."""
    if not texts.num_rows:
        return _table([], _OUT)
    own = _block(texts)
    got = {(k, p): (w, c) for k, p, w, c in zip(back["kind"].to_pylist(), back["part"].to_pylist(), blobs(back, "words"), blobs(back, "counts"), strict=True)}
    keys = own.distinct_windows()
    logs = np.empty((2, len(keys)), np.float32)
    for p, at in places(window_part(keys, parts[0])):
        logs[:, at] = LOG_STEP * unplaned(got[0, p][1], 2, np.uint16).reshape(2, -1)
    spelled = own.spelled(keys, logs)
    keys, which, words, counts, total = own.pairs()
    for p, at in places(hash_part(keys, parts[1])):
        new, told = got[1, p]
        size = -(-len(at) // 8)
        at = at[np.unpackbits(np.frombuffer(told, np.uint8, size))[: len(at)] > 0]
        numbers = unplaned(told[size:], 4, np.uint32).reshape(3, -1)
        total[at], counts[at], new = numbers[0], numbers[1:].T, np.frombuffer(new, np.uint16)
        words[at, 0], words[at[numbers[2] > 0], 1] = new[: len(at)], new[len(at) :]
    gate, hit = foretold((own.word >> np.uint64(48)).astype(np.uint32), words[which], counts[which], total[which], own.own)
    keys, which, c = own.distinct_words()
    c = c.astype(np.int64)
    for p, at in places(hash_part(keys, parts[2])):
        c[at] = unplaned(got[2, p][1], 8, np.int64)
    c = c[which]
    score = coded(own, gate, hit, chance, (c - own.own) / max(1, n), spelled, known) / math.log(10)
    total_of = lambda x: np.bincount(own.text, x, len(own.sizes))
    base = total_of(np.log10((c + 1) / (n + v + 1)))
    columns = (texts["doc_id"].to_pylist(), own.held.tolist(), own.sizes.tolist(), total_of(c > 0).astype(np.int64).tolist(), base.tolist(), score.tolist(), (total_of(spelled) / math.log(10)).tolist(), (-score * math.log2(10) / (own.raw + 1)).tolist())
    return _table(list(zip(*columns, strict=True)), _OUT)


# The corpus


def held_out() -> Column:
    return F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))


def learned_bytes(gathered: DataFrame, parts: int) -> tuple[np.ndarray, Model]:
    """Counts of (byte before, byte), and the mixing model, from the parts of the distinct windows."""

    def paired(batches):
        for batch in batches:
            for keys, c in zip(blobs(batch, "keys"), blobs(batch, "counts"), strict=True):
                sums = np.bincount((np.frombuffer(keys, np.uint64) & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(c, np.int64), 1 << 16)
                seen = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({"pair": seen, "c": sums[seen].astype(np.int64)})

    pairs = np.zeros(1 << 16, np.int64)
    for r in gathered.mapInArrow(paired, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():  # 65,536 at most
        pairs[r.pair] = r.c
    size = float(pairs.sum())
    dealt = gathered.repartition(parts, "part")

    def sums(f):
        def run(batches):
            total = None
            for batch in batches:
                for keys, c in zip(blobs(batch, "keys"), blobs(batch, "counts"), strict=True):
                    window, c = np.frombuffer(keys, np.uint64), np.frombuffer(c, np.int64)
                    for at in pieces(window, c):
                        seen = c[at] > 0
                        for row in predicted(window[at], c[at], pairs, True):
                            out = f(*(x[seen] for x in row), c[at][seen] / size)
                            total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_pydict({"bucket": [TaskContext.get().partitionId() % 32], "total": [total.tobytes()], "shape": [list(total.shape)]})

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"total": [sum(np.frombuffer(x) for x in table["total"].to_pylist()).tobytes()], "shape": [table["shape"][0].as_py()]})

        summed = dealt.mapInArrow(run, "bucket long, total binary, shape array<long>").groupBy("bucket").applyInArrow(add, "total binary, shape array<long>")
        return sum(np.frombuffer(r.total).reshape(r.shape) for r in summed.collect())  # 32 rows at most

    return pairs, learned(untrained(), sums) if size else untrained()


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, bits_per_byte."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tuple(1 + size // each for each in (WINDOWS, PAIRS, WORDS))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // BLOCK)).alias("block")
    texts = docs.select(block, "doc_id", held_out().alias("held"), "text").groupBy("block")
    sent = written(texts.applyInArrow(lambda t: _sent(t, parts), _SENT), "sent", "kind")
    of_kind = lambda k: sent.where(F.col("kind") == k)
    gathered = written(of_kind(0).groupBy("part").applyInArrow(_gathered, "part int, keys binary, counts binary"), "gathered")
    pairs, model = learned_bytes(gathered, parts[0])
    windows_back = of_kind(0).groupBy("part").cogroup(gathered.groupBy("part")).applyInArrow(lambda a, b: _answered_windows(a, b, pairs, model), _BACK)
    answers = [written(windows_back, "answers")]
    removed(gathered)
    removed(sent, part="/kind=0/")
    for wave in range(WAVES):  # the largest kind, some parts after the others, so that less is shuffled at once
        own = of_kind(1).where(F.col("part") % WAVES == wave)
        answers.append(written(own.groupBy("part").applyInArrow(_answered_pairs, _BACK), "answers"))
    removed(sent, part="/kind=1/")
    answers.append(written(of_kind(2).groupBy("part").applyInArrow(_answered_words, _BACK), "answers"))
    removed(sent)
    answers = functools.reduce(DataFrame.union, answers)
    stats = answers.where("block = -1").select("kind", F.posexplode("stats").alias("slot", "value")).groupBy("kind", "slot").agg(F.sum("value").alias("value"))
    stats = {(r.kind, r.slot): r.value for r in stats.collect()}
    n, v, twice = (int(stats.get((2, i), 0)) for i in range(3))
    places_of, hits = (np.array([stats.get((1, row * (NO_GATE + 1) + g), 0.0) for g in range(NO_GATE + 1)]) for row in (0, 1))
    chance = (hits + 0.1) / (places_of + 0.5)
    back = answers.where("block >= 0").select("block", "kind", "part", "words", "counts").groupBy("block")
    out = texts.cogroup(back).applyInArrow(lambda a, b: _scored(a, b, parts, chance, n, v, twice / max(1, n)), _OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "spelled_score", "bits_per_byte")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
