"""Dictionary units of texts: at each place the longest entry that begins there, up to seven words, taken from left to right.

The dictionary becomes a table of prefixes, as a trie written level by level: every beginning of every entry, with whether it is an entry and
whether longer ones go on from it. Places of the texts meet it one level after the other, by equality of the joined words; only places whose
words so far go on stay for the next level, so that a level costs as many rows as there are places on which entries still are possible. The
longest entries of a run of words are then folded from left to right: where one is taken, places inside it are passed over.

A run is a stretch of words with single blanks between them; no unit goes over its end. Words are runs of letters in small letters.
Null and empty texts have no runs, rows without an id are left out; without entries all units are single words. Entries that are null or
have more words than `most` are left out. Rows that share an id are joined to one text, in order of their texts, a line apart.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lexweave.sources.folders import checkpointed
from lexweave.sources.index import merged

MOST = 7
#: Characters of text in a block, and in what has its runs of words counted in one place.
BLOCK = 4_000_000
UNITS = pa.schema([("doc_id", pa.int64()), ("run", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("key", pa.string()), ("known", pa.bool_())])
FOUND = pa.schema(list(UNITS)[:-1])
#: What parts runs. Without repeated groups, which long texts would overflow the stack of the JVM's matcher with.
BREAK = r"[^\p{L} ]+|  +"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run (its number), words."""
    docs = merged(docs)
    found = F.filter(F.transform(F.split(F.lower("text"), BREAK), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(found).alias("run", "words")).select("doc_id", "run", F.split("words", " ").alias("words"))


def prefixes(entries: DataFrame, most: int = MOST) -> DataFrame:
    """level, prefix, entry, deeper from (key): each beginning of an entry once."""
    words = entries.select(F.split(F.lower("key"), " ").alias("w")).where((F.size("w") <= most) & F.col("key").isNotNull() & (F.col("key") != ""))
    each = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("level"))
    rows = each.select("level", F.array_join(F.slice("w", F.lit(1), F.col("level")), " ").alias("prefix"), (F.col("level") == F.size("w")).alias("whole"))
    return rows.groupBy("level", "prefix").agg(F.max("whole").alias("entry"), F.min("whole").alias("ends")).select("level", "prefix", "entry", (~F.col("ends")).alias("deeper"))


def longest(found: DataFrame, entries: DataFrame, most: int = MOST, least: int = 1) -> DataFrame:
    """doc_id, run, at, size: the longest entry at each place of the runs where there is one, of entries of least to most words."""
    trie = prefixes(entries, most)
    places = found.select("doc_id", "run", F.posexplode("words").alias("at", "first"), "words").select("doc_id", "run", "at", F.slice("words", F.col("at") + 1, most).alias("w"))
    alive, out = places, None
    for level in range(least, most + 1):
        own = trie.where(F.col("level") == level).select("prefix", "entry", "deeper")
        met = alive.where(F.size("w") >= level).withColumn("prefix", F.array_join(F.slice("w", 1, level), " ")).join(own, "prefix")
        hits = met.where("entry").select("doc_id", "run", "at", F.lit(level).alias("size"))
        out = hits if out is None else out.unionByName(hits)
        alive = met.where("deeper").select("doc_id", "run", "at", "w")
    return out.groupBy("doc_id", "run", "at").agg(F.max("size").alias("size"))


def units(docs: DataFrame, entries: DataFrame, most: int = MOST, least: int = 1) -> DataFrame:
    """doc_id, run, at, size, key, known: all units of the texts in order; a word that begins no entry is a unit of its own, not known."""
    found = runs(docs)
    tops = longest(found, entries, most, least).groupBy("doc_id", "run").agg(F.collect_list("at").alias("ats"), F.collect_list("size").alias("sizes"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, run, words, ats, sizes in zip(*(b[c].to_pylist() for c in ("doc_id", "run", "words", "ats", "sizes")), strict=True):
                known, at = dict(zip(ats or (), sizes or (), strict=True)), 0
                while at < len(words):
                    size = known.get(at, 1)
                    rows.append((doc, run, at, size, " ".join(words[at : at + size]), at in known))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), UNITS, strict=True)] if rows else [pa.array([], f.type) for f in UNITS], schema=UNITS)

    return found.join(tops, ["doc_id", "run"], "left").mapInArrow(fold, from_arrow_schema(UNITS))


def _sealed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all()


class _Texts:
    """The runs of a block's documents, as lists of words, and which of their stretches of so many words are frequent."""

    def __init__(self, data: bytes, parts: int):
        table = _opened(data)
        self.docs = [(doc, [r.split(" ") for r in found]) for doc, found in zip(table["doc_id"].to_pylist(), table["runs"].to_pylist(), strict=True)]
        self.parts, self.known, self.size = parts, set(), 1

    def counted(self) -> dict[int, tuple[list[str], list[int]]]:
        """By part: the next size's stretches whose two shorter ones are frequent, in order, and how many of the documents have each."""
        n, found = self.size + 1, Counter()
        for _, own in self.docs:
            keys: set[str] = set()
            for words in own:
                if n == 2:
                    keys.update(map(" ".join, zip(words, words[1:], strict=False)))
                    continue
                ok = [" ".join(words[i : i + n - 1]) in self.known for i in range(len(words) - n + 2)]
                keys.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if ok[i] and ok[i + 1])
            found.update(keys)
        out: dict[int, tuple[list[str], list[int]]] = {}
        for key in sorted(found):
            keys, times = out.setdefault(zlib.crc32(key.encode()) % self.parts, ([], []))
            keys.append(key)
            times.append(found[key])
        return out

    def told(self, answers: list[dict]) -> None:
        """Takes in which stretches are frequent."""
        for a in answers:
            self.known.update(_opened(a["keys"])["key"].to_pylist())
            self.size = max(self.size, a["size"])


def frequent(docs: DataFrame, most: int, least: int) -> DataFrame:
    """doc_id, run, at, size, key: from left to right, the longest stretches of two to `most` words that `least` documents or more have.

    Documents are packed in blocks. A block sends each of its stretches once, in order and compressed, to where the stretches of a part are
    counted, and gets those that are frequent back. A longer stretch is sent only where both stretches of a word less in it are frequent: it can't be
    in more documents than they are."""
    docs = merged(docs).select("doc_id", "text").where("text IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // BLOCK
    found = F.filter(F.transform(F.split(F.lower("text"), BREAK), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("runs"))

    def pack(table: pa.Table) -> pa.Table:
        own = table.select(["doc_id", "runs"]).combine_chunks()
        return pa.table({"block": [table["block"][0].as_py()], "data": [_sealed(own.to_batches()[0])]})

    blocks, answers = checkpointed(rows.groupBy("block").applyInArrow(pack, "block long, data binary")), None
    with_answers = lambda: blocks.withColumn("answers", F.lit(None).cast("array<struct<size: int, keys: binary>>")) if answers is None else blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("size", "keys")).alias("answers")).hint("shuffle_hash"), "block")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Texts]]:
        for b in batches:
            for i in range(len(b)):
                texts = _Texts(b["data"][i].as_py(), parts)
                texts.told(b["answers"][i].as_py() or [])
                yield b["block"][i].as_py(), texts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in each(batches):
            for part, (keys, times) in texts.counted().items():
                yield pa.RecordBatch.from_pydict({"block": [block], "part": pa.array([part], pa.int32()), "keys": [_sealed(pa.record_batch({"key": pa.array(keys), "n": pa.array(times, pa.int32())}))]})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in each(batches):
            rows = []
            for doc, own in texts.docs:
                for run, words in enumerate(own):
                    at = 0
                    while at < len(words):
                        size = next((n for n in range(min(most, len(words) - at), 1, -1) if " ".join(words[at : at + n]) in texts.known), 1)
                        if size > 1:
                            rows.append((doc, run, at, size, " ".join(words[at : at + size])))
                        at += size
            for start in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 50_000], strict=True), FOUND, strict=True)], schema=FOUND)

    def count(table: pa.Table) -> pa.Table:
        sent = [_opened(x) for x in table["keys"].to_pylist()]
        codes = pa.concat_tables(sent)["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        often = np.bincount(codes, np.concatenate([t["n"].to_numpy() for t in sent])) >= least
        ends = np.cumsum([len(t) for t in sent])[:-1]
        known = [t.select(["key"]).filter(pa.array(x)).combine_chunks() for t, x in zip(sent, np.split(often[codes], ends), strict=True)]
        return pa.table({"block": table["block"], "keys": pa.array([_sealed(pa.record_batch({"key": pa.concat_arrays([pa.array([], pa.string()), *t["key"].chunks])})) for t in known], pa.binary())})

    for size in range(2, most + 1):
        asked = with_answers().mapInArrow(send, "block long, part int, keys binary")
        told = asked.groupBy("part").applyInArrow(count, "block long, keys binary")
        own = checkpointed(told.select("block", F.lit(size).alias("size"), "keys"))
        answers = own if answers is None else answers.unionByName(own)
    return with_answers().mapInArrow(fold, from_arrow_schema(FOUND))


def grams(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """doc_id, key: the runs of so many words of each document once, found where its text is."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, found in zip(b["doc_id"].to_pylist(), b["runs"].to_pylist(), strict=True):
                keys: set[str] = set()
                for run in found or ():
                    words = run.split(" ")
                    for n in sizes:
                        keys.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(keys), pa.int64()), pa.array(list(keys), pa.string())], schema=schema)

    return merged(docs).select("doc_id", F.transform(F.split(F.lower("text"), BREAK), lambda x: F.trim(x)).alias("runs")).mapInArrow(each, from_arrow_schema(schema))
