"""Full-text search over positions: words, phrases, or, minus.

A query is read as people type it: words side by side must all be there, `or` between two of them lets either do, a minus before one
forbids it, and quotes make a phrase, whose words follow each other as far apart as in the query. Minus binds tighter than side by side,
side by side tighter than `or`. A word with other signs inside, such as `long-term`, is a phrase of its parts. A quote that isn't closed
counts as a blank, `or` without a side as nothing. With stems, words are looked up by their stem and stop words are left out, though
their places in a phrase still count; words of one letter are not indexed and are treated like stop words.

A document's score, as full-text engines count it: where words must stand together, 1 minus the product over pairs of their
occurrences of 1 minus a nearness that falls with the distance; else the mean over the words of the sum of 1 / j^2 over their
occurrences; then divided by the binary logarithm of 1 + the document's length, and mapped by s / (s + 1) below 1.

All queries of a call share one scan of the postings of their words. A query that a document without any of its words fulfils (`-word`) is
asked of all documents. An empty query, or one of stop words only, finds nothing. Phrases of many rows at once are `phrases`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.stemming import stem
from lexweave.sources.index import Index, merged

# English stop words.
STOP = set(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Occurrences of a word that a document's score looks at.
SCORED = 256


class Leaf(NamedTuple):
    """Words at offsets from the first, one or more."""

    words: tuple[tuple[str, int], ...]
    wanted: bool = True


class Branch(NamedTuple):
    kind: str  # and, or
    parts: tuple


def parse(text: str, stems: bool = True) -> Branch | Leaf | None:
    """The tree of a query; None where nothing is left to look for."""
    text = text.lower()
    if text.count('"') % 2:
        at = text.rindex('"')
        text = f"{text[:at]} {text[at + 1 :]}"
    ways: list[list[Leaf]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if bare == "or" and not minus:
            ways.append([])
            continue
        runs = re.findall(r"[^\W\d_]+", quoted or bare)
        words = [(stem(w, "en") if stems else w, i) for i, w in enumerate(runs) if len(w) >= 2 and not (stems and w in STOP)]
        if words:
            ways[-1].append(Leaf(tuple((w, i - words[0][1]) for w, i in words), not minus))
    parts = [w[0] if len(w) == 1 else Branch("and", tuple(w)) for w in ways if w]
    return None if not parts else parts[0] if len(parts) == 1 else Branch("or", tuple(parts))


def leaves(tree: Branch | Leaf) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for part in tree.parts for x in leaves(part)]


def words_of(tree: Branch | Leaf) -> list[str]:
    """Distinct words in order."""
    return list(dict.fromkeys(w for leaf in leaves(tree) for w, _ in leaf.words))


def on_empty(tree: Branch | Leaf) -> bool:
    """Whether a document with none of the words is found."""
    if isinstance(tree, Leaf):
        return not tree.wanted
    return (all if tree.kind == "and" else any)(map(on_empty, tree.parts))


def together(tree: Branch | Leaf) -> bool:
    return tree.kind == "and" if isinstance(tree, Branch) else len(tree.words) > 1


def matches(tree: Branch | Leaf, places: Mapping[str, Column]) -> Column:
    """Whether a document is found, from the sorted positions of each word in it."""
    if isinstance(tree, Branch):
        return reduce((lambda a, b: a & b) if tree.kind == "and" else (lambda a, b: a | b), (matches(p, places) for p in tree.parts))
    (first, _), *rest = tree.words
    if rest:
        found = F.exists(places[first], lambda p: reduce(lambda a, b: a & b, (F.array_contains(places[w], p + i) for w, i in rest)))
    else:
        found = F.size(places[first]) > 0
    return found if tree.wanted else ~found


def relevance(tree: Branch | Leaf, places: Mapping[str, Column], length: Column) -> Column:
    words = words_of(tree)
    own = {w: F.slice(places[w], 1, SCORED) for w in words}
    alone = reduce(lambda a, b: a + b, (F.aggregate(F.transform(own[w], lambda p, j: 1.0 / ((j + 1) * (j + 1))), F.lit(0.0), lambda a, x: a + x) for w in words)) * (0.1 / 1.64493406685) / len(words)
    if together(tree) and len(words) > 1:
        apart = lambda d: F.when((d == 0) | (d > 100), 1.0).otherwise(1.0 - 0.1 / F.sqrt(1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
        pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :]]
        missed = lambda a, b: F.aggregate(own[a], F.lit(1.0), lambda m, x: m * F.aggregate(own[b], F.lit(1.0), lambda n, y: n * apart(F.abs(x - y))))
        score = 1.0 - reduce(lambda a, b: a * b, (missed(a, b) for a, b in pairs))
    else:
        score = alone
    score = score / F.log2(F.greatest(length, F.lit(1)) + 1.0)
    return score / (score + 1.0)


def search(index: Index, queries: Mapping[int, str], stems: bool = True) -> DataFrame:
    """query_id, doc_id, score, matched (words of the query that the document has)."""
    trees = {n: t for n, text in queries.items() if (t := parse(text, stems)) is not None}
    empty = index.spark.createDataFrame([], "query_id long, doc_id long, score double, matched long")
    if not trees:
        return empty
    asked = sorted({w for t in trees.values() for w in words_of(t)})
    key = "stem" if stems else "term"
    terms = index.table("terms").where(F.col(key).isin(asked)).select("term", F.col(key).alias("word"))
    named = terms.collect()  # the forms of the queries' words
    hits = index.postings([r.term for r in named]).join(F.broadcast(index.spark.createDataFrame([(r.term, r.word) for r in named], "term string, word string")), "term")
    docs = hits.groupBy("doc_id").agg(F.collect_list(F.struct("word", "positions")).alias("hits"), F.first("len").alias("len"))
    if any(map(on_empty, trees.values())):
        docs = index.table("documents").select("doc_id", "len").join(docs.select("doc_id", "hits"), "doc_id", "left")
        docs = docs.withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<word: string, positions: array<int>>>)")))

    def places(word: str) -> Column:
        return F.array_sort(F.flatten(F.transform(F.filter("hits", lambda h: h["word"] == F.lit(word)), lambda h: h["positions"])))

    docs = docs.select("doc_id", "len", *(places(w).alias(f"w{i}") for i, w in enumerate(asked)))
    place = {w: F.col(f"w{i}") for i, w in enumerate(asked)}
    found = [
        F.when(matches(t, place), F.struct(F.lit(n).cast("long").alias("query_id"), relevance(t, place, F.col("len")).alias("score"), sum((F.size(place[w]) > 0).cast("long") for w in words_of(t)).alias("matched")))
        for n, t in trees.items()
    ]
    rows = docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("f.query_id", "doc_id", "f.score", "f.matched")


def phrases(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, times: where the phrases of many queries occur, from (query_id, term, at), at being the word's offset.

    A phrase is looked for by its rarest word: only that word's postings are matched against its other words, by term and document, so the
    work follows the rarest words, not the common ones. Starting places that all of the words agree on are kept."""
    known = asked.join(index.table("terms").select("term", "df"), "term")
    rarest = known.groupBy("query_id").agg(F.min_by(F.struct("term", "at"), F.struct("df", "term", "at")).alias("r"))
    size = asked.groupBy("query_id").agg(F.count("*").alias("words"))
    posted = index.postings().select("term", "doc_id", "positions")
    starts = rarest.select("query_id", "r.*").join(posted, "term")
    starts = starts.select("query_id", "doc_id", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start")).where("start >= 0")
    need = starts.join(asked, "query_id").select("query_id", "doc_id", "start", "term", "at")
    held = need.join(posted, ["term", "doc_id"]).where(F.array_contains("positions", (F.col("start") + F.col("at")).cast("int")))
    whole = held.groupBy("query_id", "doc_id", "start").agg(F.count("*").alias("n")).join(size, "query_id").where("n = words")
    return whole.groupBy("query_id", "doc_id").agg(F.count("*").alias("times"))


def phrases_of(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """query_id, doc_id, times: where phrases of `size` words occur in texts (doc_id, text), from (query_id, phrase), words a blank apart.

    For many phrases of common words, which no rarest word narrows down: every place of a text is looked up among the phrases, which
    all tasks hold, so that neither texts nor postings travel."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    texts = merged(docs).select("doc_id", words.alias("words")).where(F.size("words") >= size)
    places = texts.select("doc_id", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (size - 1))).alias("at"))
    found = places.select("doc_id", F.array_join(F.slice("words", F.col("at"), size), " ").alias("phrase")).join(F.broadcast(asked), "phrase")
    return found.groupBy("query_id", "doc_id").agg(F.count("*").alias("times"))
