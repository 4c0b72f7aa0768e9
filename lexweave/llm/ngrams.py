"""N-gram Jaccard join by T-occurrence search.

Two texts link when their sets of word shingles overlap in `percent` of their union, so a set of n links only with sets that hold
T = ceil(percent * n / 100) of its shingles. Texts with equal sets are one.

1. Survivors. In any common order of the shingles, here that of their hashes, linked sets share l among the first n - T + l of
   each. Those beginnings are counted by hash range; a batch sends a shingle once, however many of its texts hold it, so that a
   common passage makes no hot task. Sets of whose beginning fewer than l shingles occur elsewhere link with nothing.
2. Inverted lists. Among the survivors, shingles are ordered by how many sets hold them; one that another set lacks is first.
   Linked sets share one of the first n - T + 1, so these alone are listed: rare ones, the long lists of common passages left out.
3. T-occurrence search. A set is a query against candidates from its lists: DivideSkip heap-merges the short lists, probes the
   long ones by binary search, and keeps the candidates that reach the overlap. In the first rounds a set is asked about few
   others of its lists, which joins groups of near copies in linear work; the last asks about every pair of a list that is in
   different components by then. Pairs that sizes, places in the order or bitmaps rule out for certain are never asked about.
   Queries go out in blocks of candidates with `BLOCK` shingles.

A text is shingled once for its key and its beginning, and a second time if its set survives. Sets are told by 64 bits of their key
where a table has one column for them.

Null and empty texts have no shingles and link with nothing; shorter ones are one shingle; a very long text is a large set of its
own, and blocks of candidates are bounded by shingles, not by sets. Ties in length or frequency fall by hash. Rows with the same set
are one class, whatever their ids: different texts under one id are each compared, and rows with a null id stay. component_id is the
smallest id of the component, null where no row of it has one. An empty table gives an empty result. Columns but doc_id and text are
left aside.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexweave.llm import shingles
from lexweave.llm.common import documents, forget, removed, small_batches, written
from lexweave.llm.components import components
from lexweave.llm.shingles import set_key, shingle_set

PERCENT = 75
#: l as a share of the set, in percent: more sends more shingles and leaves fewer survivors.
DEPTH = 25
#: Postings of a task of step 1, and those a task gathers before it sends them on; shingles in a block of candidates.
POSTINGS, GATHERED, BLOCK = 1_500_000, 3_000_000, 1 << 18
#: Bytes of text for each shingle, to judge the number of tasks.
BYTES = 7
#: As many survivors as this are broadcast to the texts, 4 MB; where there are more, texts are shuffled to them.
BROADCAST = 200_000
#: Partners that a set is asked about in each round before the last.
ROUNDS = (2, 8)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """T: the shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def depth(n: int) -> int:
    return max(1, n * DEPTH // 100)


def pair_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap at which sets of n and m link: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: np.ndarray, records: list[np.ndarray], needs: list[int]) -> list[int]:
    """Places of the records that share at least their need of shingles with the query."""
    least, lists = min(needs), {}
    for place, record in enumerate(records):
        for shingle in record[np.isin(record, query, assume_unique=True)].tolist():
            lists.setdefault(shingle, []).append(place)
    ordered = sorted(lists.values(), key=len, reverse=True)
    if len(ordered) < least:
        return []
    long, short = ordered[: least - 1], ordered[least - 1 :]
    found = []
    for place, seen in groupby(heapq.merge(*short)):
        count = sum(1 for _ in seen)
        if count >= least - len(long):
            for places in long:
                at = bisect_left(places, place)
                count += at < len(places) and places[at] == place
            if count >= needs[place]:
                found.append(place)
    return found


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and what tells a row by both: two hashes, `row` and `more`."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.hash("text", "doc_id").alias("more"))


def _postings(sets: dict[int, np.ndarray], parts: int, owners: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """Rows of kind 0, the shingles of hash range `part` with the set that holds each (a place in `table` from 1, or 0 for several), and
    of kind 1, how many shingles of each set several of these sets hold, by what the set's key leaves modulo `owners`."""
    keys = np.fromiter(sets, np.int64, len(sets))
    sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
    hashes, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    times = np.diff(np.r_[first, len(hashes)])
    here = np.bincount(owner, np.repeat(times > 1, times), len(keys)).astype(np.uint32)
    sent, whose = hashes[first], np.where(times > 1, 0, owner[first] + 1)
    part = (sent >> np.uint64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    low = (sent & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        at = order[bounds[p] : bounds[p + 1]]
        present, place = np.unique(np.r_[0, whose[at]], return_inverse=True)
        yield p, 0, low[at].tobytes(), place[1:].astype(np.uint16).tobytes(), keys[present[1:] - 1].tobytes()
    to = keys % owners
    for p in np.unique(to[here > 0]).tolist():
        mine = (here > 0) & (to == p)
        yield p, 1, here[mine].tobytes(), b"", keys[mine].tobytes()


_PASS = "doc_id long, row long, more int, n long, high long, low long, kind int, part int, shingles binary, whose binary, table binary"


def first_pass(docs: DataFrame, parts: int, owners: int, percent: int) -> DataFrame:
    """From one reading of the texts: rows without a kind, the key (high, low) and size n of each text's set, and the packed beginnings
    of _postings."""
    schema = _parse_datatype_string(_PASS)
    arrow = to_arrow_schema(schema)

    def batch_of(columns: dict[str, list], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def posted(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = list(_postings(sets, parts, owners)) if sets else []
        for start in range(0, len(rows), 500):
            part = rows[start : start + 500]
            names = ("part", "kind", "shingles", "whose", "table")
            yield batch_of(dict(zip(names, map(list, zip(*part, strict=True)), strict=True)), len(part))

    def run(batches):
        forget(shingles.__name__)
        beginnings: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            keys = []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                high, low = set_key(found)
                keys.append((len(found), high, low))
                if len(found) and high not in beginnings:
                    own = beginnings[high] = found[: len(found) - least_overlap(len(found), percent) + depth(len(found))]
                    held += len(own)
                if held >= GATHERED or len(beginnings) >= 60_000:
                    yield from posted(beginnings)
                    beginnings, held = {}, 0
            own = {"doc_id": batch.column(0), "row": batch.column(2), "more": batch.column(3)}
            yield batch_of(own | dict(zip(("n", "high", "low"), map(list, zip(*keys, strict=True)), strict=True)) if keys else own, batch.num_rows)
        yield from posted(beginnings)

    return identified(docs).mapInArrow(run, schema)


def _shared(sent: pa.Table, owners: int) -> pa.Table:
    """How many shingles of a hash range each set shares with others, packed by what its key leaves modulo `owners`."""
    shingle = np.frombuffer(b"".join(sent["shingles"].to_pylist()), np.uint32)
    key = np.concatenate([np.r_[0, np.frombuffer(t, np.int64)][np.frombuffer(w, np.uint16)] for w, t in zip(sent["whose"].to_pylist(), sent["table"].to_pylist(), strict=True)])
    order = np.argsort(shingle, kind="stable")
    shingle, key = shingle[order], key[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    several = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | np.logical_or.reduceat(key == 0, first)
    shared = key[np.repeat(several, np.diff(np.r_[first, len(key)]))]
    found, times = np.unique(shared[shared != 0], return_counts=True)
    to = found % owners
    parts = np.unique(to)
    columns = [parts, [times[to == p].astype(np.uint32).tobytes() for p in parts], [found[to == p].tobytes() for p in parts]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "shingles", "table"])


def shared_in_beginnings(passed: DataFrame, owners: int) -> DataFrame:
    """high, shared: how many shingles of a set's beginning occur in other sets' beginnings, never too few. Postings and counts go
    packed, by hash range there and by set back."""

    def total(sent: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b, np.int64) for b in sent["table"].to_pylist()])
        found, at = np.unique(keys, return_inverse=True)
        times = np.concatenate([np.frombuffer(b, np.uint32) for b in sent["shingles"].to_pylist()])
        return pa.table({"high": found, "shared": np.bincount(at, times, len(found)).astype(np.int64)})

    counts = passed.where("kind = 0").select("part", "shingles", "whose", "table").groupBy("part").applyInArrow(lambda t: _shared(t, owners), "part int, shingles binary, table binary")
    counts = counts.union(passed.where("kind = 1").select("part", "shingles", "table"))
    return counts.groupBy("part").applyInArrow(total, "high long, shared long")


def survivor_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """doc, n, shingles of the survivors (row, more, high): doc is their high. Equal rows meet in the join and are read once."""

    schema = "doc long, n int, shingles array<long>"

    def run(batches):
        forget(shingles.__name__)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_pydict({"doc": part.column(0), "n": np.diff(ends), "shingles": lists})

    if survivors.count() <= BROADCAST:
        survivors = F.broadcast(survivors)
    rows = identified(docs).join(survivors, ["row", "more"]).groupBy("row", "more").agg(F.first("high").alias("high"), F.first("text").alias("text"))
    return rows.select("high", "text").mapInArrow(run, schema)


def searched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, m) that link: a is a query, the b of a block, with m shingles each, are its records."""

    def run(batches):
        for batch in batches:
            out = {"a": [], "b": []}
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "n", "query", "records")]
            for i in range(batch.num_rows):
                a, n, query, records = (c[i] for c in columns)
                a, n, records = a.as_py(), n.as_py(), records.values
                sets = records.field("shingles")
                found = divide_skip(query.values.to_numpy(), [x.values.to_numpy() for x in sets], [pair_overlap(n, m, percent) for m in records.field("m").to_pylist()])
                ids = records.field("b").to_pylist()
                out["a"] += [a] * len(found)
                out["b"] += [ids[j] for j in found]
            yield pa.RecordBatch.from_pydict({k: np.array(v, np.int64) for k, v in out.items()})

    so_far = F.sum("m").over(Window.partitionBy("a").orderBy("b"))
    records = pairs.select("a", "b", F.floor(so_far / BLOCK).alias("block"))
    records = records.join(sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), "shingles"), "b")
    grouped = records.groupBy("a", "block").agg(F.collect_list(F.struct("b", "m", "shingles")).alias("records"))
    queries = grouped.join(sets.select(F.col("doc").alias("a"), "n", F.col("shingles").alias("query")), "a")
    return queries.select("a", "n", "query", "records").mapInArrow(run, "a long, b long")


#: 64-bit words of a set's parity bitmap.
BITMAP = 4


def _bitmap(shingles: str) -> Column:
    """A bit for each hash class, set where an odd number of the shingles fall into it."""
    word = lambda k: F.aggregate(shingles, F.lit(0).cast("long"), lambda bits, x: F.when(F.pmod(F.shiftrightunsigned(x, 6), F.lit(BITMAP)) == k, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(bits))
    return F.array(*(word(k) for k in range(BITMAP)))


def _near(a: Column, b: Column, percent: int) -> Column:
    """False only where a shingle can't be the first that linked sets share: sizes n too far apart, or too few shingles left, `rest`."""
    near = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    return near & ((100 + percent) * F.least(a["rest"], b["rest"]) >= percent * (a["n"] + b["n"]))


def about(sets: DataFrame, name: str) -> DataFrame:
    """name, of_name: what bounds how many shingles of a set and another can be the same."""
    return sets.select(F.col("doc").alias(name), F.struct("n", (F.col("n") - F.size("shingles")).alias("alone"), "bits").alias(f"of_{name}"))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """False only for pairs of which too many shingles differ: those that no other set holds, and one for each bit in which the bitmaps
    differ."""
    differ = a["alone"] + b["alone"]
    for k in range(BITMAP):
        differ = differ + F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k]))
    n = a["n"] + b["n"]
    return (100 + percent) * (n - differ) >= 2 * percent * n


def ordered_sets(survivors: DataFrame, percent: int) -> DataFrame:
    """doc, n, shingles that several survivors hold, rare ones first, and their bitmap; sets with too few such are left out."""
    postings = survivors.select("doc", "n", F.explode("shingles").alias("shingle"))
    common = postings.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = F.sort_array(F.collect_list(F.struct("times", "shingle")))["shingle"]
    ordered = postings.join(common, "shingle").groupBy("doc").agg(F.first("n").alias("n"), shared.alias("shingles"))
    ordered = ordered.where(F.size("shingles") >= F.ceil(percent * F.col("n") / 100))
    return ordered.withColumn("bits", _bitmap("shingles"))


def asked(lists: DataFrame, sets: DataFrame, partners: int | None, turn: int, percent: int) -> DataFrame:
    """a, b, m of the pairs to search: sets of one list that are in different components. With `partners`, a set asks about few others,
    those that lead its lists this turn, without it about all."""
    own = F.struct("doc", "n", "rest")
    lead = F.min_by(F.struct(own.alias("own"), "component"), F.xxhash64("doc", F.lit(turn)))
    spread = lists.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), lead.alias("lead")).where("least < most")
    if partners:
        pairs = lists.join(spread, "shingle").where((F.col("component") != F.col("lead.component")) & _near(own, F.col("lead.own"), percent))
        pairs = pairs.select(F.col("lead.own.doc").alias("a"), F.col("doc").alias("b")).distinct()
        pairs = pairs.join(about(sets, "a"), "a").join(about(sets, "b"), "b").where(_may_link(F.col("of_a"), F.col("of_b"), percent)).select("a", "b", F.col("of_b.n").alias("m"))
        few = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("a", F.lit(turn)).alias("by"), "a", "m"))), 1, partners)
        return pairs.groupBy("b").agg(few.alias("few")).select("b", F.inline("few")).select("a", "b", "m")
    mixed = lists.join(spread.select("shingle"), "shingle").join(about(sets, "doc"), "doc").select("shingle", "component", own.alias("own"), "of_doc")
    other = mixed.select("shingle", F.col("component").alias("of"), F.col("own").alias("other"), F.col("of_doc").alias("of_other"))
    able = _near(F.col("own"), F.col("other"), percent) & _may_link(F.col("of_doc"), F.col("of_other"), percent)
    pairs = mixed.join(other, "shingle").where((F.col("of") < F.col("component")) & able)
    return pairs.groupBy(F.col("other.doc").alias("a"), F.col("own.doc").alias("b")).agg(F.first("own.n").alias("m"))


def linked_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, more, n, group of each row: rows with equal groups are linked, directly or by others; null for empty sets. Texts and
    blocks of candidates go to Python in small batches, whatever the session's own."""
    with small_batches(docs.sparkSession):
        return _linked_rows(docs, percent)


def _linked_rows(docs: DataFrame, percent: int) -> DataFrame:
    parts = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, parts * (100 - percent + DEPTH) // 100 // BYTES // POSTINGS)
    owners = -(-parts // 8)
    passed = written(first_pass(docs, parts, owners, percent), "first_pass")
    rows = written(passed.where("kind is null").select("doc_id", "row", "more", "n", "high", "low"), "rows")
    classes = rows.where("n > 0").groupBy("high", "low").agg(F.min(F.struct("row", "more")).alias("pick"), F.first("n").alias("n"))
    # a partner may be as small as T, and so may its depth
    needed = F.greatest(F.lit(1), F.floor(F.ceil(percent * F.col("n") / 100) * DEPTH / 100))
    shared = shared_in_beginnings(passed, owners)
    survivors = written(classes.join(shared, "high").where(F.col("shared") >= needed).select("pick.row", "pick.more", "high"), "survivors")
    removed(passed)
    found = written(survivor_sets(docs, survivors), "survivor_sets")
    sets = written(ordered_sets(found, percent), "sets")
    removed(survivors, found)
    # the bitmap is made once a set, before explode()
    beginning = F.slice("shingles", F.lit(1), F.greatest(F.lit(0), F.size("shingles") - F.ceil(percent * F.col("n") / 100).cast("int") + 1))
    listed = sets.select("doc", "n", F.size("shingles").alias("size"), F.posexplode(beginning).alias("i", "shingle"))
    lists = written(listed.select("shingle", "doc", "n", (F.col("size") - F.col("i")).alias("rest")), "lists")
    links, nodes = None, None
    for turn, partners in enumerate((*ROUNDS, None)):
        now = lists.withColumn("component", F.col("doc"))
        if nodes is not None:
            now = lists.join(nodes.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        pairs = written(asked(now, sets, partners, turn, percent), "pairs")
        linked = searched(pairs, sets, percent)
        before, links = links, written(linked if links is None else links.union(linked), "links")
        removed(pairs, *([] if before is None else [before]))
        nodes = components(links)
    removed(lists, sets, links)
    grouped = rows.where("n > 0").join(nodes.withColumnRenamed("node", "high"), "high", "left")
    grouped = grouped.select("doc_id", "row", "more", "n", F.coalesce("component", "high").alias("group"))
    return grouped.union(rows.where("n = 0").select("doc_id", "row", "more", "n", F.lit(None).cast("long")))


def linked_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows = linked_rows(docs, percent)
    least = rows.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows, with all columns: that with the smallest id, null ids last, the smallest hash of its text
    among different texts of one id. Rows without shingles link with nothing and stay; of rows equal in id and text one is left."""
    rows = linked_rows(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "more")).alias("first")
    kept = rows.where("n > 0").groupBy("group").agg(first).select("first.row", "first.more")
    kept = kept.union(rows.where("n = 0").select("row", "more").distinct())
    own = docs.select(F.struct("*").alias("own"), F.xxhash64("doc_id", "text").alias("row"), F.hash("text", "doc_id").alias("more"))
    return own.join(kept, ["row", "more"], "left_semi").dropDuplicates(["row", "more"]).select("own.*")


def op10_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
r(node, hop) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.hop),
c AS (SELECT node, min(hop) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
