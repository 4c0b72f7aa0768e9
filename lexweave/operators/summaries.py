"""Sentences of documents with their places and the weights of their terms, made a document at a time where its text is.

A document's terms meet their idf once, by term, and come back to the text once, by document; sentences, their scores, terms and
likenesses are then worked out in Arrow batches. Sentences are those of the macro @pieces: paragraphs end at line feeds, a sentence ends
at a mark with its closers, unless a full stop stands after an abbreviation, a letter or a number, or a small letter follows; pieces without
a letter are passed over. A term's weight is 0.5 * (1 + tf / largest tf) * idf. Null texts have no sentences; rows without an id are left
out; ids are taken to be of one row each.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexweave.operators.text import ABBREVIATIONS
from lexweave.sources.index import TASK_ROWS, Index

TOKEN = re.compile(r"[ \t\r\f]*[^ \t\r\f]+[ \t\r\f]*|[ \t\r\f]+")
END = re.compile(r"[ \t\r\f]*(.*?)([.!?…]+)[\"'”»)\]]*[ \t\r\f]*\Z", re.S)
#: Sentences of a summary and keywords of a document.
SELECTED, KEYWORDS = 5, 15
#: Terms of a sentence that are given, and how far below the last of them others are given too, for rounding to tell them apart.
CONTRIBUTED, CLOSE = 6, 1e-8


class Sentence(NamedTuple):
    text: str
    start: int  # in the document
    whole: int
    inside: int  # in the paragraph
    paragraph: int  # its length


@functools.cache
def letters() -> re.Pattern:
    """Runs of letters of all scripts."""
    ranges, begin = [], None
    for c in range(sys.maxunicode + 2):
        letter = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == "L"
        if letter and begin is None:
            begin = c
        elif not letter and begin is not None:
            ranges.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return re.compile(f"[{''.join(ranges)}]+")


def _small(token: str) -> bool:
    c = token[:1]
    return c.lower() == c and c.upper() != c


def _ends(token: str, after: str) -> bool:
    found = END.match(token)
    if not found or _small(after):
        return False
    word = found[1].lower().lstrip("(\"'")
    alone = re.fullmatch("[0-9]+", word) or len(word) == 1 and unicodedata.category(word)[0] == "L"
    return not (found[2][0] == "." and (word in ABBREVIATIONS or alone))


def sentences(text: str | None) -> list[Sentence]:
    found, place, last = [], 0, 0
    for p, paragraph in enumerate((text or "").split("\n")):
        tokens = TOKEN.findall(paragraph)
        if not tokens:
            continue
        inside, piece = 0, ""
        for i, token in enumerate(tokens):
            piece += token
            after = tokens[i + 1].lstrip(" ") if i + 1 < len(tokens) else ""
            if i + 1 == len(tokens) or _ends(token, after):
                found.append((piece, place + p + inside, inside, len(paragraph)))
                inside, piece = inside + len(piece), ""
        place, last = place + len(paragraph), p
    return [Sentence(s, start, place + last, inside, length) for s, start, inside, length in found if letters().search(s)]


def terms(sentence: str) -> Counter:
    return Counter(w for w in letters().findall(sentence.lower()) if len(w) >= 2)


def weighted(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, text, terms, tfs, idfs from (doc_id, text)."""
    tasks = max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), 1 + index.manifest["postings"] // TASK_ROWS)
    rows = index.postings().select("doc_id", "term", "tf").repartition(tasks, "term").join(index.table("terms").select("term", "idf").hint("shuffle_hash"), "term")
    own = rows.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"), F.collect_list("idf").alias("idfs"))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").repartition(tasks, "doc_id").join(own.hint("shuffle_hash"), "doc_id", "left")


def each(found: DataFrame, function: Callable[[str, dict[str, float], dict[str, int]], Iterator[tuple]], schema: str) -> DataFrame:
    """What a function makes of the text, the terms' weights and their counts of each document, after its id."""
    target = _parse_datatype_string(f"doc_id long, {schema}")
    arrow = to_arrow_schema(target)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for start in range(0, len(batch), 50):
                b = batch.slice(start, 50)
                for doc, text, names, tfs, idfs in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "terms", "tfs", "idfs")), strict=True):
                    most = max(tfs or (1,))
                    weights = {t: 0.5 * (1 + tf / most) * idf for t, tf, idf in zip(names or (), tfs or (), idfs or (), strict=True)}
                    for row in function(text, weights, dict(zip(names or (), tfs or (), strict=True))):
                        rows.append((doc, *row))
                        if len(rows) >= 20_000:
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)

    return found.select("doc_id", "text", "terms", "tfs", "idfs").mapInArrow(run, target)


def scores(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, i, s, w, score, terms, posd, posp of every sentence: its score is the sum of tf * weight, w that by its places."""

    def scored(text: str, weights: dict[str, float], _: dict[str, int]) -> Iterator[tuple]:
        for i, s in enumerate(sentences(text)):
            own = [(n, weights[t]) for t, n in terms(s.text).items() if t in weights]
            score, posd, posp = float(sum(n * w for n, w in own)), 1 - s.start / s.whole, 1 - s.inside / s.paragraph
            yield i, s.text, posd * posp * score, score, sum(n for n, _ in own) if own else None, posd, posp

    return each(weighted(index, docs), scored, "i long, s string, w double, score double, terms long, posd double, posp double")


def measures(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, chars, lead, coverage, top_kept, top_total, position, last_third of every document with sentences: its summary is of the
    sentences of the largest w. The characters in it, the share of its sentences that begin the document, the share of the document's keywords
    that its terms have, how many of the sentences of the largest score it keeps and how many those are, the mean of its sentences' places,
    and how many of them begin in the last third."""

    def measured(text: str, weights: dict[str, float], counts: dict[str, int]) -> Iterator[tuple]:
        found = sentences(text)
        own = [[t for t in terms(s.text) if t in weights] for s in found]
        content = [float(sum(n * weights[t] for t, n in terms(s.text).items() if t in weights)) for s in found]
        placed = [(1 - s.start / s.whole) * (1 - s.inside / s.paragraph) * c for s, c in zip(found, content, strict=True)]
        first = lambda values: sorted(range(len(found)), key=lambda i: (-round(values[i], 9), i))[:SELECTED]
        kept, top = first(placed), first(content)
        keywords = sorted(weights, key=lambda t: (-round(weights[t], 9), -counts[t], t))[:KEYWORDS]
        said = {t for i in kept for t in own[i]}
        if kept:
            chars, lead, last = sum(len(found[i].text) for i in kept), kept.count(0) / len(kept), sum(3 * found[i].start > 2 * found[i].whole for i in kept)
            position = sum(found[i].start / found[i].whole for i in kept) / len(kept)
            yield chars, lead, sum(t in said for t in keywords) / max(1, len(keywords)), len({*kept} & {*top}), len(top), position, last

    return each(weighted(index, docs), measured, "chars long, lead double, coverage double, top_kept long, top_total long, position double, last_third long")


def selected(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, i, s, w: the sentences of the largest w of every document, a few more where they are as good as equal."""

    def chosen(text: str, weights: dict[str, float], _: dict[str, int]) -> Iterator[tuple]:
        placed = []
        for i, s in enumerate(sentences(text)):
            score = float(sum(n * weights[t] for t, n in terms(s.text).items() if t in weights))
            placed.append((i, s.text, (1 - s.start / s.whole) * (1 - s.inside / s.paragraph) * score))
        # equal sentences fall to the earlier one, which rounding may bring in
        least = sorted((w for *_, w in placed), reverse=True)[SELECTED - 1] - CLOSE if len(placed) > SELECTED else -1.0
        yield from (row for row in placed if row[2] >= least)

    return each(weighted(index, docs), chosen, "i long, s string, w double")


def contributions(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, i, term, w: the heaviest terms of every sentence, weights compared to nine places; ties fall to the smaller term."""

    def chosen(text: str, weights: dict[str, float], _: dict[str, int]) -> Iterator[tuple]:
        for i, s in enumerate(sentences(text)):
            own = [(n * weights[t], t) for t, n in terms(s.text).items() if t in weights]
            # equal weights fall to the smaller term, which rounding may bring in
            least = sorted((w for w, _ in own), reverse=True)[CONTRIBUTED - 1] - CLOSE if len(own) > CONTRIBUTED else -1.0
            kept = [(t, w) for w, t in own if w >= least]
            yield i, [t for t, _ in kept], [w for _, w in kept]

    found = each(weighted(index, docs), chosen, "i long, own array<string>, ws array<double>")
    ranked = F.array_sort(F.zip_with("own", "ws", lambda t, w: F.struct((-F.round(w, 9)).alias("key"), t.alias("term"), w.alias("w"))))
    return found.select("doc_id", "i", F.explode(F.slice(ranked, 1, CONTRIBUTED)).alias("x")).select("doc_id", "i", "x.term", "x.w")


def edges(index: Index, docs: DataFrame, least: float) -> DataFrame:
    """doc_id, a, b, sim: sentences of one document with a cosine above least, each pair once."""

    def alike(text: str, weights: dict[str, float], _: dict[str, int]) -> Iterator[tuple]:
        vectors = [(i, own) for i, s in enumerate(sentences(text)) if (own := {t: n * weights[t] for t, n in terms(s.text).items() if weights.get(t, 0) > 0})]
        posted: dict[str, tuple[list[int], list[float]]] = {}
        for place, (_, own) in enumerate(vectors):
            for t, v in own.items():
                at, values = posted.setdefault(t, ([], []))
                at.append(place)
                values.append(v)
        lists = {t: (np.array(at), np.array(values)) for t, (at, values) in posted.items()}
        norms = np.array([np.sqrt(sum(v * v for v in own.values())) for _, own in vectors])
        numbers = np.array([i for i, _ in vectors])
        for place, (i, own) in enumerate(vectors):
            dots = np.zeros(len(vectors))
            for t, v in own.items():
                at, values = lists[t]
                dots[at] += v * values
            sims = dots[place + 1 :] / (norms[place] * norms[place + 1 :])
            for k in np.flatnonzero(sims > least):
                yield i, int(numbers[place + 1 + k]), float(sims[k])

    return each(weighted(index, docs), alike, "a long, b long, sim double")
