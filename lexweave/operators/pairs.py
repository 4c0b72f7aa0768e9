"""All pairs of texts by what words they share, block against block.

Rows are (id, more, size, words, weights): two numbers that name a text, its norm or how many words count, its words and their weights.
Without weights a word weighs as often as it is there. Rows are packed in blocks, a compressed row of a table each; every block of the one
side meets every block of the other, and a pair of blocks gives the sums of the products of the weights of shared words as a matrix: by a
matrix product for words that many texts of both have, and word by word for the others. So no shared word is a row of its own, nothing is
shuffled by word or by pair, and a task holds some blocks and a matrix, whatever a word's frequency. Blocks are shuffled once and never
come to the driver: each task reads a share of the one side against a share of the other. The work grows with the pairs all the same.

Texts without words share nothing. Rows whose id, more or size is null are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.sources.folders import checkpointed

#: Texts of a block, and words of a block, each once a text: a block is full at the first of them.
BLOCK, ENTRIES = 1024, 500_000
#: Bytes of the blocks, as packed, of a share that a task holds; the other side's share is read along, of so many times that.
SENT, READ = 16 << 20, 8
#: Words go by a matrix product where they have this share of all pairs; columns of such a matrix; products of other words made at once.
COMMON, COLUMNS, MATCHES = 0.01, 2048, 1_000_000
#: Rows of a batch that is given; blocks that a task keeps unpacked.
GIVEN, HELD = 100_000, 24
PACKED = "number long, data binary"


class Block(NamedTuple):
    number: int
    ids: np.ndarray
    more: np.ndarray
    sizes: np.ndarray
    known: pa.Array  # distinct words
    rows: np.ndarray  # for each word of a text, by word: the text's place here,
    codes: np.ndarray  # the word's place in known,
    weights: np.ndarray
    plain: bool  # all weights are 1, and few enough for sums of them to be exact in single precision


#: What a pair of blocks gives: columns of the result, in batches.
Given = Callable[[Block, Block], Iterator[pa.RecordBatch]]


def _entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """id, more, size, distinct words and their weights of each row."""
    weighted = batch["weights"].to_pylist()
    for i, (one, two, size) in enumerate(zip(batch["id"].to_pylist(), batch["more"].to_pylist(), batch["size"].to_pylist(), strict=True)):
        words = batch["words"][i].values
        if words is None:
            continue
        if weighted[i] is None:
            counted = pc.value_counts(words)
            yield one, two, size, counted.field("values"), counted.field("counts").to_numpy().astype(np.float64)
        else:
            yield one, two, size, words, np.array(weighted[i], np.float64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, entries, made = [], 0, 0
    base = TaskContext.get().partitionId() << 32

    def pack() -> pa.RecordBatch:
        waiting.sort(key=lambda r: r[:2])
        encoded = pa.concat_arrays([r[3].cast(pa.string()) for r in waiting]).dictionary_encode()
        codes = encoded.indices.to_numpy().astype(np.int32)
        by = np.argsort(codes, kind="stable")
        rows = np.repeat(np.arange(len(waiting), dtype=np.int32), [len(r[3]) for r in waiting])
        entries = pa.record_batch({"rows": rows[by], "codes": codes[by], "weights": np.concatenate([r[4] for r in waiting])[by]})
        texts = pa.record_batch({"ids": np.array([r[0] for r in waiting], np.int64), "more": np.array([r[1] for r in waiting], np.int64), "sizes": np.array([r[2] for r in waiting], np.float64)})
        sink = pa.BufferOutputStream()
        for part in (texts, pa.record_batch({"known": encoded.dictionary}), entries):
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(part)
        return pa.RecordBatch.from_pydict({"number": [base + made], "data": [sink.getvalue().to_pybytes()]})

    for batch in batches:
        for row in _entries(batch):
            waiting.append(row)
            entries += len(row[3])
            if len(waiting) == BLOCK or entries >= ENTRIES:
                yield pack()
                waiting, entries, made = [], 0, made + 1
    if waiting:
        yield pack()


def packed(texts: DataFrame) -> DataFrame:
    """Blocks of texts (id, more, size, words, weights)."""
    kept = texts.where("id IS NOT NULL AND more IS NOT NULL AND size IS NOT NULL AND size(words) > 0")
    return kept.select("id", "more", F.col("size").cast("double").alias("size"), "words", F.col("weights").cast("array<double>").alias("weights")).mapInArrow(_packed, PACKED)


def _block(number: int, data: pa.Buffer) -> Block:
    source = pa.BufferReader(data)
    texts, known, entries = (pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(3))
    column = lambda table, name: table[name].to_numpy()
    weights = column(entries, "weights")
    plain = len(weights) < 1 << 24 and bool((weights == 1).all())
    return Block(number, *(column(texts, c) for c in ("ids", "more", "sizes")), pa.concat_arrays(known["known"].chunks), column(entries, "rows"), column(entries, "codes"), weights, plain)


def products(a: Block, b: Block) -> np.ndarray:
    """For each text of a and each of b, the sum over shared words of the products of their weights."""
    out = np.zeros((len(a.ids), len(b.ids)))
    if not len(a.known) or not len(b.known):
        return out
    place = pc.fill_null(pc.index_in(b.known, value_set=a.known), -1).to_numpy()[b.codes]
    shared = place >= 0
    b_rows, b_codes, b_weights = b.rows[shared], place[shared], b.weights[shared]
    in_a, in_b = np.bincount(a.codes, minlength=len(a.known)), np.bincount(b_codes, minlength=len(a.known))
    common = in_a * in_b >= max(1.0, COMMON * out.size)
    dense = np.flatnonzero(common)
    for at in range(0, len(dense), COLUMNS):
        column = np.full(len(a.known), -1, np.int32)
        column[dense[at : at + COLUMNS]] = np.arange(len(dense[at : at + COLUMNS]))
        sides = []
        for rows, codes, weights, many in ((a.rows, a.codes, a.weights, len(a.ids)), (b_rows, b_codes, b_weights, len(b.ids))):
            some = column[codes] >= 0
            side = np.zeros((many, min(COLUMNS, len(dense) - at)), np.float32 if a.plain and b.plain else np.float64)
            side[rows[some], column[codes[some]]] = weights[some]
            sides.append(side)
        out += sides[0] @ sides[1].T
    starts = np.cumsum(in_a) - in_a
    rare = ~common[b_codes]
    b_rows, b_codes, b_weights = b_rows[rare], b_codes[rare], b_weights[rare]
    many = in_a[b_codes]
    ends = np.cumsum(many)
    at = 0
    while at < len(b_codes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + MATCHES, side="right")))
        n = many[at:to]
        own = np.repeat(starts[b_codes[at:to]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = a.rows[own].astype(np.int64) * len(b.ids) + np.repeat(b_rows[at:to], n)
        out += np.bincount(cell, a.weights[own] * np.repeat(b_weights[at:to], n), out.size).reshape(out.shape)
        at = to
    return out


def compared(asked: DataFrame, texts: DataFrame | None, give: Given, schema: str) -> DataFrame:
    """What give makes of each pair of a block of asked and one of texts. Without texts asked are compared among themselves: each pair of
    blocks once, in the order of their numbers, and a block with itself."""
    blocks = checkpointed(packed(asked))  # read twice, and a block must be the same both times
    others = blocks if texts is None else checkpointed(packed(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, held = None, {}  # the block that is read along, and the share that each of those meets
        for batch in batches:
            for i, (a, b) in enumerate(zip(batch["a_number"].to_pylist(), batch["b_number"].to_pylist(), strict=True)):
                if one is None or one.number != a:
                    one = _block(a, batch["a_data"][i].as_buffer())
                if b not in held:
                    if len(held) > HELD:
                        held.clear()
                    held[b] = _block(b, batch["b_data"][i].as_buffer())
                yield from give(one, held[b])

    def share(df: DataFrame, side: str, least: int, size: int) -> tuple[DataFrame, int]:
        told = df.agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("blocks")).first()
        number = max(1, min(told.blocks, max(least, -(-(told.bytes or 0) // max(1, size)))))
        return df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("number", "data"))).repartition(number), number

    tasks = 8 * blocks.sparkSession.sparkContext.defaultParallelism
    b, shares = share(others, "b", 1, SENT)
    a, _ = share(blocks, "a", -(-tasks // shares), READ * SENT)
    once = F.lit(True) if texts is not None else F.col("a_number") <= F.col("b_number")
    return a.hint("shuffle_replicate_nl").join(b, once).mapInArrow(run, schema)


def _sliced(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for at in range(0, len(whole), GIVEN):
        yield whole.slice(at, GIVEN)


def ratios(asked: DataFrame, texts: DataFrame | None = None, jaccard: bool = False, least: float | None = None) -> DataFrame:
    """a, b, value of all pairs of different ids that share a word: the sum of products by the product of sizes, or, for sets, by the size of
    the union. Without texts each pair is there once, a < b. least: only pairs with that value or more."""
    among = texts is None

    def give(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        sums = products(a, b)
        met = sums != 0
        if least is None and not (a.weights.all() and b.weights.all()):  # words that count for nothing are shared all the same
            met = products(*(x._replace(weights=np.ones(len(x.weights)), plain=True) for x in (a, b))) != 0
        met &= a.ids[:, None] < b.ids if among and a.number == b.number else a.ids[:, None] != b.ids
        value = sums / (a.sizes[:, None] + b.sizes - sums if jaccard else a.sizes[:, None] * b.sizes)
        if least is not None:
            met &= value >= least
        i, j = np.nonzero(met)
        one, two = a.ids[i], b.ids[j]
        if among:
            one, two = np.minimum(one, two), np.maximum(one, two)
        yield from _sliced({"a": one, "b": two, "value": value[i, j]})

    return compared(asked, texts, give, "a long, b long, value double")


LIKE = "id long, more long, other_id long, other_more long, value double"


def _likeness(a: Block, b: Block) -> np.ndarray:
    """Shared words by words of either; -1 for a text with itself, or where none is shared."""
    sums = products(a, b)
    same = (a.ids[:, None] == b.ids) & (a.more[:, None] == b.more)
    return np.where((sums > 0) & ~same, sums / (a.sizes[:, None] + b.sizes - sums), -1.0)


def _both_ways(i: np.ndarray, j: np.ndarray, a: Block, b: Block, value: np.ndarray) -> dict[str, np.ndarray]:
    return {"id": a.ids[i], "more": a.more[i], "other_id": b.ids[j], "other_more": b.more[j], "value": value}


def like(texts: DataFrame, least: float) -> DataFrame:
    """id, more, other_id, other_more, value of all ordered pairs of sets whose intersection is that share of their union, or a larger one."""

    def give(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        value = _likeness(a, b)
        i, j = np.nonzero(value >= least)
        yield from _sliced(_both_ways(i, j, a, b, value[i, j]))
        if a.number != b.number:
            yield from _sliced(_both_ways(j, i, b, a, value[i, j]))

    return compared(texts, None, give, LIKE)


def likest(texts: DataFrame) -> DataFrame:
    """id, more, other_id, other_more, value: the likest other set of each, values compared to nine places; ties fall to the smaller id and
    more. A pair of blocks gives a row a set, and those that rounding alone can put before it."""

    def first(value: np.ndarray, a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        most = value.max(axis=1, initial=-1.0)
        i, j = np.nonzero((value > 0) & (value >= most[:, None] - 2e-9))
        kept = _firsts(i, value[i, j])
        yield from _sliced(_both_ways(i[kept], j[kept], a, b, value[i[kept], j[kept]]))

    def give(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        value = _likeness(a, b)
        yield from first(value, a, b)
        if a.number != b.number:
            yield from first(value.T, b, a)

    found = compared(texts, None, give, LIKE)
    least = F.min(F.struct((-F.round("value", 9)).alias("key"), "other_id", "other_more", "value")).alias("least")
    return found.groupBy("id", "more").agg(least).select("id", "more", "least.other_id", "least.other_more", "least.value")


def _firsts(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each row has each of its values first."""
    order = np.lexsort((np.arange(len(rows)), values, rows))
    new = (np.diff(rows[order], prepend=-1) != 0) | (np.diff(values[order], prepend=np.nan) != 0)
    return np.sort(order[new])
