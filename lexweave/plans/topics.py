"""The topics that retrieval queries ask, chosen from the index's own terms: thirty topics of three terms."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lexweave.sources.index import Index

COMMON, PICKED, TOPICS = 30, 60, 30
_chosen: dict[tuple[str, int], tuple[list[str], list[str]]] = {}


def hash_of(text: object) -> int:
    """As the macro @hash has it."""
    return int(hashlib.md5(str(text).encode()).hexdigest()[:8], 16)


def chosen(index: Index) -> tuple[list[str], list[str]]:
    """The commonest terms, and some that a hash picks from the others; kept for a version of an index."""
    key = (index.path, index.number)
    if key not in _chosen:
        terms = index.table("terms").where(F.length("term") >= 4)
        common = [r.term for r in terms.orderBy(F.desc("df"), "term").limit(COMMON).select("term").collect()]
        order = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long")
        picked = [r.term for r in terms.where(~F.col("term").isin(common)).orderBy(order, "term").limit(PICKED).select("term").collect()]
        _chosen[key] = common, picked
    return _chosen[key]


def topics(index: Index) -> dict[int, list[str]]:
    """Topic number to its terms, ordered by their hash."""
    out: dict[int, list[str]] = {}
    for group in chosen(index):
        for i, term in enumerate(sorted(group, key=lambda t: (hash_of(t), t))):
            out.setdefault(1 + i % TOPICS, []).append(term)
    return {n: sorted(terms, key=lambda t: (hash_of(t), t)) for n, terms in out.items()}


def pairs(index: Index) -> dict[int, list[str]]:
    """Neighbours among the commonest terms."""
    common = chosen(index)[0]
    return {i: list(two) for i, two in enumerate(zip(common, common[1:], strict=False), start=1)}


def websearch(number: int, terms: list[str]) -> str:
    """A topic as a person might type it: five forms in turn."""
    a, b, c = (*terms, "", "")[:3]
    return [f"{a} {b}", f"{a} or {b} -{c}", f'"{a} {b}"', f"{a} -{b}", f"{a} {b} or {c}"][number % 5]
