"""The commonest letter grams of documents, each counted where the document is read.

A gram is one to five characters of a word of two letters or more with a `_` at either end. Rows that share an id are one document whose
grams are ranked together, languages apart; rows without an id are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, MOST = 5, 300
TOP = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("r", pa.int32())])


@functools.lru_cache(100_000)
def grams(word: str) -> tuple[str, ...]:
    w = f"_{word}_"
    return tuple(w[p : p + k] for p in range(len(w)) for k in range(1, min(LONGEST, len(w) - p) + 1))


def commonest(parts: list[dict], most: int = MOST) -> list[tuple[str | None, str]]:
    """lang and gram of the commonest grams of a document's parts (lang, words); ties fall to the smaller gram."""
    counts: dict[tuple[str | None, str], int] = {}
    for part in parts:
        lang, words = part["lang"], {}
        for w in part["words"] or ():
            words[w] = words.get(w, 0) + 1
        own: dict[str, int] = {}
        for w, c in words.items():
            if len(w) >= 2:
                for g in grams(w):
                    own[g] = own.get(g, 0) + c
        for g, c in own.items():
            counts[lang, g] = counts.get((lang, g), 0) + c
    least = sorted(counts.values(), reverse=True)[most - 1] if len(counts) > most else 0
    kept = sorted(((-c, g, lang or "", lang) for (lang, g), c in counts.items() if c >= least), key=lambda x: x[:3])
    return [(lang, g) for _, g, _, lang in kept[:most]]


def top_grams(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, lang, gram, r: the rank from 0 of each document's commonest grams, from (doc_id, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 100):
                b = batch.slice(start, 100)
                rows = [(i, lang, g, r) for i, parts in zip(b["doc_id"].to_pylist(), b["parts"].to_pylist(), strict=True) for r, (lang, g) in enumerate(commonest(parts, most))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TOP, strict=True)], schema=TOP)

    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "lang", "text")
    part = F.struct("lang", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        parts = docs.groupBy("doc_id").agg(F.collect_list(part).alias("parts"))
    else:
        parts = docs.select("doc_id", F.array(part).alias("parts"))
    return parts.mapInArrow(run, "doc_id long, lang string, gram string, r int")
