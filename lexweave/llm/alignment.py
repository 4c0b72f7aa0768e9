"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how often they do in the whole corpus.

The texts of a batch are joined, each after one blank, and both tokenizers' tokens laid over the same bytes. Token lengths summed up give
their end offsets, the ends of A and of B are counted once per byte, and where both have one the bytes are cut into groups. Prefix sums
over the bytes and over the groups, read at the ends of documents, give all counts per document. All of a group's A tokens are linked
with all of its B tokens.

How many documents of the corpus hold a pair linked needs an exchange. A task collects texts up to `BLOCK` bytes into a block: its
documents, with their pairs as places in the block's list of distinct pairs, and that list with the number of its documents that hold
each. The lists are summed by pair, and each block gets the sums of its own list back. So a pair travels once a block, never once a
document, no task holds more than a block, and the only table that is broadcast has a row for each A id at most.

Texts that are null or empty, or that one of the tokenizers doesn't spell byte by byte, have no tokens: zeros and an empty digest. Very
long texts are one document of one block. Repeated rows are documents of their own, with or without an id. Ties for an A id's highest
count are all best. An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lexweave.llm.common import documents, removed, written

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are laid out at once, and of a block.
SLICE, BLOCK = 1 << 20, 1 << 23
#: A pair's key is its A id times this and its B id.
SHIFT = 1 << 16
#: Groups with more links than this are counted by distinct ids before they are linked.
MANY = 64


class Spelling(NamedTuple):
    """The bytes of all tokens of a vocabulary, joined, and where each starts."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelling:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, other bytes from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(public_tokenizers.path(first))
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=public_tokenizers.path(second))
        letters = byte_letters()
        names = {i: t for t, i in self.first.get_vocab().items()}
        self.a = Spelling.of([bytes(letters[c] for c in names[i]) if all(c in letters for c in names[i]) else names[i].encode() for i in range(len(names))])
        pieces = [(self.second.id_to_piece(i), self.second.is_byte(i)) for i in range(self.second.get_piece_size())]
        self.b = Spelling.of([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.second.encode(texts, num_threads=1)
        return [np.array(x.ids, np.int32) for x in a], [np.array(x, np.int32) for x in b]


@functools.lru_cache(1)
def tokenizers(first: str = FIRST, second: str = SECOND) -> Pair:
    """One per worker process."""
    return Pair(first, second)


class Aligned(NamedTuple):
    """What a batch has per document: counts, the digest, and its distinct pairs, `pairs` of them, in the joined arrays keys and times."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    pairs: np.ndarray
    keys: np.ndarray
    times: np.ndarray


def spelled(spelling: Spelling, ids: list[np.ndarray], data: list[bytes]) -> np.ndarray:
    """Which documents their tokens spell byte by byte."""
    right = np.array([int(spelling.size[i].sum()) == len(d) for i, d in zip(ids, data, strict=True)], bool)
    at = np.flatnonzero(right)
    if len(at):
        same = spelling.spell(np.concatenate([ids[k] for k in at])) == np.frombuffer(b"".join(data[k] for k in at), np.uint8)
        right[at] = np.logical_and.reduceat(same, np.cumsum([0, *(len(data[k]) for k in at[:-1])]))
    return right


def runs(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, joined."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def grouped(group: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group, how often each is there, and how many a group has."""
    keys, times = np.unique(group.astype(np.int64) * SHIFT + ids, return_counts=True)
    return keys % SHIFT, times, np.bincount(keys // SHIFT, minlength=groups)


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, key and number of links, for all pairs of A and B ids in a group; pairs may come again."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    out = []
    for large in (False, True):
        chosen = (n_a * n_b > MANY) == large
        in_a, in_b = chosen[group_a], chosen[group_b]
        if large:
            own_a, times_a, n_a = grouped(group_a[in_a], a[in_a], groups)
            own_b, times_b, n_b = grouped(group_b[in_b], b[in_b], groups)
        else:
            own_a, own_b = a[in_a], b[in_b]
        of_a, of_b = np.where(chosen, n_a, 0), np.where(chosen, n_b, 0)
        links = of_a * of_b
        group = np.repeat(np.arange(groups), links)
        place, width = runs(links), of_b[group]
        at_a = (np.cumsum(of_a) - of_a)[group] + place // np.maximum(width, 1)
        at_b = (np.cumsum(of_b) - of_b)[group] + place % np.maximum(width, 1)
        times = times_a[at_a] * times_b[at_b] if large else np.ones(len(group), np.int64)
        out.append((group, own_a[at_a].astype(np.int64) * SHIFT + own_b[at_b], times))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def written_out(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, last: np.ndarray, groups: int) -> tuple[bytes, np.ndarray]:
    """All groups as text, a1,a2|b1;a3|b2,b3; and where each ends. last: groups that end a document, after which there's no mark."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_b, until_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + until_a[group_b]
    ids = np.empty(len(a) + len(b), np.int32)
    ids[at_a], ids[at_b] = a, b
    mark = np.full(len(ids), ord(","), np.uint8)
    ends = until_a + np.cumsum(n_b)
    mark[until_a + before_b - 1], mark[ends - 1] = ord("|"), ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
    end = np.cumsum(digits + 1)
    text = np.empty(end[-1] if len(end) else 0, np.uint8)
    text[end - 1] = mark
    rest = ids
    for k in range(6):
        on = digits > k
        text[end[on] - 2 - k] = ord("0") + rest[on] % 10
        rest = rest // 10
    return text.tobytes(), end[ends - 1] - last


def align(texts: list[str | None], pair: Pair) -> Aligned:
    """The alignment of a batch of texts."""
    n = len(texts)
    there = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = pair.encoded([texts[i] for i in there])
    data = [b" " + texts[i].encode("utf-8") for i in there]
    right = np.flatnonzero(spelled(pair.a, ids_a, data) & spelled(pair.b, ids_b, data)) if there else np.array([], np.int64)
    doc = np.array(there, np.int64)[right] if there else right
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "pairs")}
    digest = [""] * n
    if not len(doc):
        return Aligned(**out, digest=digest, keys=np.array([], np.int64), times=np.array([], np.int64))
    a, b = (np.concatenate([x[k] for k in right]) for x in (ids_a, ids_b))
    out["n_a"][doc], out["n_b"][doc] = [len(ids_a[k]) for k in right], [len(ids_b[k]) for k in right]
    ends = np.cumsum([len(data[k]) for k in right])
    end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
    both = (np.bincount(end_a, minlength=ends[-1] + 1) > 0) & (np.bincount(end_b, minlength=ends[-1] + 1) > 0)
    until = np.cumsum(both)  # groups that end here or before
    group_a, group_b, groups = until[end_a - 1], until[end_b - 1], int(until[-1])
    group_ends = until[ends]
    n_groups = np.diff(group_ends, prepend=0)
    out["n_groups"][doc] = n_groups
    links = np.cumsum(np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups))
    out["n_links"][doc] = np.diff(links[group_ends - 1], prepend=0)
    last = np.zeros(groups, np.int64)
    last[group_ends - 1] = 1
    text, text_end = written_out(group_a, a, group_b, b, last, groups)
    begin = 0
    for d, g in zip(doc, group_ends, strict=True):
        digest[d] = hashlib.sha256(text[begin : text_end[g - 1]]).hexdigest()
        begin = text_end[g - 1] + 1
    group, key, times = linked(group_a, a, group_b, b, groups)
    owner = np.repeat(np.arange(len(doc)), n_groups)[group].astype(np.uint64)
    order = np.argsort((owner << np.uint64(32)) | key.astype(np.uint64))
    owner, key, times = owner[order], key[order], times[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
    out["pairs"][doc] = np.bincount(owner[first].astype(np.int64), minlength=len(doc))
    return Aligned(**out, digest=digest, keys=key[first], times=np.add.reduceat(times, first))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if not len(values) or values.max() < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LONGS = [(c, pa.int64()) for c in ("doc_id", *COUNTS)]
BLOCKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), *_LONGS, ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])
RESULT = pa.schema([*_LONGS, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


class Block:
    """Documents that wait for the corpus-wide counts of their pairs."""

    def __init__(self, number: int):
        self.number, self.size, self.ids, self.parts = number, 0, [], []

    def add(self, ids: list, texts: list[str | None], size: int, pair: Pair) -> None:
        self.ids += ids
        self.parts.append(align(texts, pair))
        self.size += size

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Its documents (kind 0) and its list of pairs (kind 1)."""
        keys, place, held = np.unique(np.concatenate([p.keys for p in self.parts]), return_inverse=True, return_counts=True)
        times, pairs = (np.concatenate([getattr(p, k) for p in self.parts]) for k in ("times", "pairs"))
        ends, n = np.cumsum(pairs), len(self.ids)
        cuts = [slice(e - c, e) for e, c in zip(ends, pairs, strict=True)]
        rows = {
            "kind": [0] * n + [1],
            "block": [self.number] * (n + 1),
            "doc_id": [*self.ids, None],
            "groups_sha256": [d for p in self.parts for d in p.digest] + [None],
            "places": [packed(np.diff(place[c], prepend=0)) for c in cuts] + [None],
            "times": [packed(times[c]) for c in cuts] + [None],
            "keys": [None] * n + [keys],
            "held": [None] * n + [held],
        } | {k: np.append(np.concatenate([getattr(p, k) for p in self.parts]), 0) for k in COUNTS}
        yield pa.RecordBatch.from_pydict({name: rows[name] for name in BLOCKS.names}, schema=BLOCKS)


def blocks(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """Aligned documents and lists of pairs, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = tokenizers(first, second), TaskContext.get().partitionId() << 32
        own, ids, texts, size = Block(number), [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 64
                if size >= SLICE:
                    own.add(ids, texts, size, pair)
                    ids, texts, size = [], [], 0
                    if own.size >= block:
                        yield from own.rows()
                        number += 1
                        own = Block(number)
        if ids:
            own.add(ids, texts, size, pair)
        if own.ids:
            yield from own.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, from_arrow_schema(BLOCKS))


def answered(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of a block with their links weighed by the corpus-wide sums of the block's pairs."""
    total, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
    place = sums["place"].to_numpy()
    total[place], best[place] = sums["total"].to_numpy(), sums["best"].cast(pa.int64()).to_numpy()
    found: dict[str, list[int]] = {"n_best": [], "count_sum": []}
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, n = np.cumsum(unpacked(places)), unpacked(times)
        found["n_best"].append(int(n @ best[at]))
        found["count_sum"].append(int(n @ total[at]))
    return pa.table({name: found[name] if name in found else docs[name] for name in RESULT.names}, schema=RESULT)


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    stored = written(blocks(docs, first, second, block), "aligned", by="kind")
    pairs = stored.where("kind = 1").select(F.col("block").alias("in_block"), F.posexplode(F.arrays_zip("keys", "held")).alias("place", "pair")).select("in_block", "place", F.col("pair.keys").alias("key"), "pair.held")
    totals = pairs.groupBy("key").agg(F.sum("held").alias("total")).withColumn("a", F.shiftright("key", 16))
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))  # a row for each A id: as many as the vocabulary has, at most
    totals = totals.join(F.broadcast(highest), "a").select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    sums = pairs.join(totals, "key").select("in_block", "place", "total", "best")
    rows = stored.where("kind = 0").drop("kind", "keys", "held")
    out = written(rows.groupBy("block").cogroup(sums.groupBy("in_block")).applyInArrow(answered, from_arrow_schema(RESULT)), "linked")
    removed(stored)
    return out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
