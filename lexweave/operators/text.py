"""Operators that need a loop over one text or one group: sentences, snippets, TextRank, MMR, ROUGE-L, links, spoken numbers.

Plain Python on one text, with Arrow-batched DataFrame forms beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our own choice: abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = {"e.g", "i.e", "etc", "fig", "eq", "al", "dr", "mr", "mrs", "prof", "vs", "cf", "no", "vol", "pp"}
#: English number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), start=2)}


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence: a terminator with its closers, a blank, and no lower-case letter after it."""
    text, out, start = text or "", [], 0
    for end in re.finditer(r"[.!?…]+[\"'”»)\]]*(?=\s|$)|\n+", text):
        word = re.search(r"([^\s]+)$", text[start : end.start()])
        last = word[1].lower().strip("(\"'") if word else ""
        after = text[end.end() :].lstrip()[:1]
        stop = end[0].startswith(".") and (last in ABBREVIATIONS or re.fullmatch(r"[^\W\d_]|\d+", last)) or after.islower() and not end[0].startswith("\n")
        if not stop:
            piece = text[start : end.end()]
            if piece.strip():
                out.append((start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())))
            start = end.end()
    if text[start:].strip():
        piece = text[start:]
        out.append((start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())))
    return out


def tokens(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) >= 2]


def textrank(texts: list[str], weights: dict[str, float] | None = None, damping: float = 0.85, rounds: int = 100, least: float = 0.03, enough: float = 1e-6) -> list[float]:
    """PageRank of sentences over the cosine of their vectors of tf * weight; terms without a weight count for nothing, all for 1 where
    no weights are given. The rank of sentences without neighbours is spread over all."""
    n, vectors = len(texts), []
    for t in texts:
        vector = {w: c * (1.0 if weights is None else weights.get(w, 0.0)) for w, c in Counter(tokens(t)).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append({w: v / norm for w, v in vector.items()} if norm else {})
    edges = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            sim = sum(v * vectors[j].get(w, 0.0) for w, v in vectors[i].items())
            if sim > least:
                edges[i][j] = edges[j][i] = sim
    out = [sum(row) for row in edges]
    rank = [1 / n] * n if n else []
    for _ in range(rounds):
        loose = sum(r for r, o in zip(rank, out, strict=True) if not o)
        new = [(1 - damping) / n + damping * (loose / n + sum(rank[j] * edges[j][i] / out[j] for j in range(n) if edges[j][i])) for i in range(n)]
        done = sum(abs(a - b) for a, b in zip(rank, new, strict=True)) < enough
        rank = new
        if done:
            break
    return rank


def mmr(relevance: list[float], sets: list[set[str]], most: int, balance: float = 0.7) -> list[int]:
    """Greedy maximal marginal relevance with Jaccard similarity; ties to the earlier."""
    chosen: list[int] = []
    while len(chosen) < min(most, len(relevance)):
        best, top = None, -math.inf
        for i, r in enumerate(relevance):
            if i not in chosen:
                like = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0 for j in chosen), default=0.0)
                score = balance * r - (1 - balance) * like
                if score > top:
                    best, top = i, score
        chosen.append(best)
    return chosen


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, start=1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def snippet(text: str | None, query: set[str], width: int = 300) -> tuple[str, list[tuple[int, int]]]:
    """The window with most distinct, then most matches of the query, and their places in it."""
    text = text or ""
    hits = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in query]
    if not hits:
        return text[:width], []
    best = max(range(len(hits)), key=lambda i: (len({w for a, _, w in hits[i:] if a < hits[i][0] + width}), sum(a < hits[i][0] + width for a, _, _ in hits[i:]), -i))
    start = max(0, hits[best][0] - width // 3)
    while start and not text[start - 1].isspace():
        start -= 1
    part = text[start : start + width]
    return part, [(a - start, b - start) for a, b, _ in hits if a >= start and b <= start + width]


def links(html: str | None, base: str | None, most: int = 500) -> list[str]:
    """Absolute targets of the page's links in order, without fragments, nofollow links and repeats."""
    out: dict[str, None] = {}
    for tag in re.findall(r"<a\s[^>]*>", html or "", re.I):
        target = re.search(r"href\s*=\s*[\"']([^\"']*)", tag, re.I)
        if target and "nofollow" not in tag.lower():
            url = urljoin(base or "", target[1]).partition("#")[0]
            if urlsplit(url).scheme in ("http", "https"):
                out[url] = None
    return list(out)[:most]


def words_to_digits(text: str | None) -> str:
    """Runs of English number words as figures: twenty one -> 21."""
    out, total = [], None
    for word in (text or "").lower().split():
        value = UNITS.get(word, TENS.get(word))
        if value is not None:
            total = value if total is None else total + value if total % 10 == 0 and value < 10 and total else total * 100 + value
        elif word == "hundred" and total is not None:
            total *= 100
        else:
            if total is not None:
                out.append(str(total))
            total = None
            out.append(word)
    return " ".join([*out, str(total)] if total is not None else out)


def per_row(df: DataFrame, columns: list[str], function: Callable, schema: str, keep: str) -> DataFrame:
    """keep, and what function makes of the columns of each row, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(f"{keep} long, out {schema}")
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            data = batch.to_pydict()
            yield pa.RecordBatch.from_pydict({keep: data[keep], "out": [function(*row) for row in zip(*(data[c] for c in columns), strict=True)]}, schema=arrow)

    return df.select(keep, *(c for c in columns if c != keep)).mapInArrow(run, target)


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, i, start, stop of each sentence."""
    spans = per_row(docs, ["text"], lambda t: [{"start": a, "stop": b} for a, b in sentences(t)], "array<struct<start:int,stop:int>>", "doc_id")
    return spans.select("doc_id", F.posexplode("out").alias("i", "s")).select("doc_id", "i", "s.start", "s.stop")
