"""The stored inverted index: segments of documents, added to and deleted from, read as one.

A segment holds the documents of one addition in three Parquet tables: `forward` (doc_id, term, tf, len, positions), in runs of
documents; `postings`, the same rows range-partitioned and sorted by (term, doc_id), so that a query's terms prune row groups and a
common term is many tasks' work; `documents` (doc_id, len). `gone` (doc_id) names what a segment deletes from those before it; a document that is added again
replaces the earlier one. Terms are lower-cased runs of letters, two or more; positions count all runs of letters of the text.

A version is a list of segments and what depends on the whole collection: `documents` (doc_id, segment, len, norm) of those alive,
`terms` (term, stem, df, cf, idf), and the counts. idf = ln(N / df), 0 where a term is in every document; a raw weight is tf * idf; norm
is that of a document's raw weights, null where it has no terms. Everything is written under new names; the manifest that makes it a version is
renamed into place last, so that a crash at any step leaves the version before. Reading merges: rows of a segment count if the document
is alive in that very segment. `compact` merges on disk, `vacuum` deletes what no version needs.

A null text has no terms; rows without an id are not indexed; an id that several rows of one addition have is one document of their
texts, in order of the texts, a line apart.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lexweave.operators.stemming import with_stems
from lexweave.sources.folders import create, delete, exists, fingerprint, listed, read_text, shared_folder

VERSION = 2
#: Postings that one task sorts or adds up, so that it needs no disk for them.
TASK_ROWS = 1_000_000
#: Terms that have one in so many of all postings, so at most so many terms, have their weights broadcast for the norms.
COMMON = 1 << 20
#: Forward and postings take a sixth less than by the default.
CODEC = "zstd"
FORWARD = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("len", pa.int64()), ("positions", pa.list_(pa.int32()))])
_built: dict[tuple[str, str], str] = {}


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, term."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return docs.select("doc_id", F.posexplode(words).alias("pos", "term")).where(F.length("term") >= 2)


def merged(docs: DataFrame) -> DataFrame:
    """doc_id, text, a row each; texts are brought together by id only if an id is met twice."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("text", F.lit("")))), "\n").alias("text"))
    return docs


def analysed(docs: DataFrame) -> DataFrame:
    """Rows of `forward` of docs (doc_id, text), in runs of documents. Words are counted a batch of documents at a time."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return merged(docs).sortWithinPartitions("doc_id").select("doc_id", words.alias("words")).mapInArrow(counted, from_arrow_schema(FORWARD))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `forward`, by document and term, from (doc_id, words)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b["words"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begins = np.concatenate([[0], ends])[:-1]
        words = pc.dictionary_encode(pc.list_flatten(b["words"]))
        if not len(words):
            continue
        known, codes = words.dictionary, words.indices.to_numpy()
        order = pc.sort_indices(known).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(ends)), ends - begins)
        at = np.flatnonzero(pc.greater_equal(pc.utf8_length(known), 2).to_numpy(zero_copy_only=False)[codes])
        key = doc[at] * len(order) + place[codes[at]]
        by = np.argsort(key, kind="stable")  # positions stay in order
        at, key = at[by], key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        own, sizes = doc[at[first]], np.bincount(doc[at], minlength=len(ends))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - begins[doc[at]], pa.int32()))
        made = [b["doc_id"].cast(pa.int64()).take(pa.array(own)), known.take(pa.array(codes[at[first]])).cast(pa.string()), pa.array(np.diff(np.append(first, len(at))), pa.int32()), pa.array(sizes[own], pa.int64()), positions]
        rows = pa.RecordBatch.from_arrays(made, schema=FORWARD)
        for start in range(0, len(rows), 50_000):
            yield rows.slice(start, 50_000)


class Index:
    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        """The index at a path, in its latest version unless a number is given."""
        self.spark, self.path = spark, path
        self.number = max(self.versions(spark, path), default=0) if number is None else number
        self.manifest = json.loads(read_text(spark, f"{path}/manifest-{self.number:08d}")) if self.number else {"segments": [], "tables": None}

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        return sorted(int(m[1]) for name in listed(spark, path) if (m := re.fullmatch(r"manifest-(\d{8})", name)))

    # ---- writing

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> Index:
        """A version of docs (doc_id, text) alone, whatever there was before."""
        index = cls(docs.sparkSession, path)
        return index._committed([index._segment(docs)])

    def add(self, docs: DataFrame) -> Index:
        """A version with docs too; those whose id is there already are replaced."""
        return self._committed([*self.manifest["segments"], self._segment(docs)])

    def delete(self, ids: DataFrame) -> Index:
        """A version without the documents of ids (doc_id)."""
        name = uuid.uuid4().hex
        ids.select("doc_id").where("doc_id IS NOT NULL").distinct().write.parquet(f"{self.path}/segments/{name}/gone")
        return self._committed([*self.manifest["segments"], {"name": name, "gone": True}])

    def compact(self) -> Index:
        """The same documents in one segment; nothing is analysed again."""
        return self._committed([self._stored(self._alive("forward").sortWithinPartitions("doc_id", "term"), self.table("documents").select("doc_id"))])

    def vacuum(self) -> None:
        """Deletes the folders and manifests that this version doesn't need."""
        kept = {s["name"] for s in self.manifest["segments"]} | {self.manifest["tables"], f"manifest-{self.number:08d}"}
        for folder in ("segments", "versions", ""):
            for name in listed(self.spark, f"{self.path}/{folder}"):
                if name not in kept and (folder or name.startswith(("manifest-", "."))):
                    delete(self.spark, f"{self.path}/{folder}/{name}")

    def _segment(self, docs: DataFrame) -> dict:
        """Analyses docs, each where it is read. Only an id that several rows have makes the texts travel."""
        return self._stored(analysed(docs), docs.select("doc_id").where("doc_id IS NOT NULL").distinct())

    def _stored(self, forward: DataFrame, ids: DataFrame) -> dict:
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        forward.write.parquet(f"{base}/forward", compression=CODEC)
        forward = self.spark.read.parquet(f"{base}/forward")
        postings = forward.drop("tf").repartitionByRange(1 + forward.count() // TASK_ROWS, "term", "doc_id").sortWithinPartitions("term", "doc_id")
        postings.select("doc_id", "term", F.size("positions").alias("tf"), "len", "positions").write.parquet(f"{base}/postings", compression=CODEC)
        sizes = forward.groupBy("doc_id").agg(F.first("len").alias("len"))
        ids.join(sizes, "doc_id", "left").select("doc_id", F.coalesce("len", F.lit(0)).alias("len")).write.parquet(f"{base}/documents")
        return {"name": name, "gone": False}

    def _committed(self, segments: list[dict]) -> Index:
        """Writes what depends on the whole collection, then the manifest."""
        name = uuid.uuid4().hex
        base, read = f"{self.path}/versions/{name}", self.spark.read.parquet
        entries = []
        for i, s in enumerate(segments):
            table = read(f"{self.path}/segments/{s['name']}/{'gone' if s['gone'] else 'documents'}")
            entries.append(table.select("doc_id", F.lit(i).alias("segment"), (F.lit(None).cast("long") if s["gone"] else F.col("len")).alias("len")))
        alive = reduce(DataFrame.unionByName, entries)
        if len(segments) > 1:
            alive = alive.groupBy("doc_id").agg(F.max_by(F.struct("segment", "len"), "segment").alias("s")).select("doc_id", "s.*")
        alive.where("len IS NOT NULL").write.parquet(f"{base}/alive")
        alive = read(f"{base}/alive")
        counts = alive.agg(F.count("*").alias("documents"), F.avg("len").alias("avgdl")).first()
        postings = self._alive("postings", segments, alive).select("doc_id", "term", "tf")
        n = counts.documents
        terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))
        idf = F.when((F.col("df") >= n) | (F.col("df") <= 0), 0.0).otherwise(F.ln(F.lit(n) / F.col("df")))
        with_stems(terms.withColumn("idf", idf)).select("term", "stem", "df", "cf", "idf").sortWithinPartitions("term").write.parquet(f"{base}/terms", compression=CODEC)
        terms = read(f"{base}/terms")
        of_terms = terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
        norms = self._norms(self._alive("forward", segments, alive).select("doc_id", "term", "tf"), terms, of_terms.postings)
        alive.join(norms, "doc_id", "left").select("doc_id", "segment", "len", "norm").write.parquet(f"{base}/documents")
        delete(self.spark, f"{base}/alive")
        told = {"segments": segments, "tables": name, "documents": n, "avgdl": counts.avgdl, "terms": of_terms.terms, "postings": of_terms.postings}
        number = self.number + 1
        if not create(self.spark, f"{self.path}/manifest-{number:08d}", json.dumps(told)):
            raise Conflict(f"version {number} of {self.path} is there already")
        return Index(self.spark, self.path, number)

    def _norms(self, counts: DataFrame, terms: DataFrame, postings: int) -> DataFrame:
        """doc_id, norm, of counts (doc_id, term, tf) in runs of documents. Most postings are of a few common terms, whose weights come to where
        the documents are; only postings of rare terms travel."""
        often = F.col("df") >= postings / COMMON
        common, others = (terms.where(c).select("term", "idf") for c in (often, ~often))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + postings // TASK_ROWS)
        rare = counts.join(F.broadcast(common), "term", "left_anti").repartition(tasks, "term").join(others.hint("shuffle_hash"), "term")
        raw = F.col("tf") * F.col("idf")
        return counts.join(F.broadcast(common), "term").unionByName(rare).groupBy("doc_id").agg(F.sqrt(F.sum(raw * raw)).alias("norm"))

    # ---- reading

    def _alive(self, kind: str, segments: list[dict] | None = None, alive: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
        """Rows of a kind of table of all segments, of living documents only."""
        segments = self.manifest["segments"] if segments is None else segments
        parts = []
        for i, s in enumerate(segments):
            if not s["gone"]:
                part = self.spark.read.parquet(f"{self.path}/segments/{s['name']}/{kind}")
                parts.append((part if terms is None else part.where(F.col("term").isin(terms))).withColumn("segment", F.lit(i)))
        if not parts:
            return self.spark.createDataFrame([], "doc_id long, term string, tf int, len long, positions array<int>")
        rows = reduce(DataFrame.unionByName, parts)
        if len(segments) > 1:
            alive = self.table("documents") if alive is None else alive
            rows = rows.join(alive.select("doc_id", "segment"), ["doc_id", "segment"])
        return rows.drop("segment")

    def postings(self, terms: Iterable[str] | None = None) -> DataFrame:
        """doc_id, term, tf, len, positions: of some terms, or of all."""
        return self._alive("postings", terms=None if terms is None else sorted(set(terms)))

    def forward(self) -> DataFrame:
        """The same rows in runs of documents."""
        return self._alive("forward")

    def table(self, name: str) -> DataFrame:
        """`postings`, `documents`, `terms` or `stats`, a row of documents, terms, postings and avgdl."""
        if name == "postings":
            return self.postings()
        if name == "stats":
            told = [tuple(self.manifest[k] for k in ("documents", "terms", "postings", "avgdl"))]
            return self.spark.createDataFrame(told, "documents long, terms long, postings long, avgdl double")
        return self.spark.read.parquet(f"{self.path}/versions/{self.manifest['tables']}/{name}")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, anew: bool = False) -> Index:
        """The index of a folder's documents, built if the shared folder has none of these very files, or if it is to be made anew."""
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        key = (spark.sparkContext.applicationId, fingerprint(docs))
        path = _built.get(key, f"{shared_folder(spark)}/index-{VERSION}-{key[1]}")
        if anew or (key not in _built and not cls.versions(spark, path)):
            cls.build(docs, path).vacuum()
        _built[key] = path
        return cls(spark, path)

    def views(self) -> None:
        """Temporary views stored_postings, stored_terms, stored_documents, stored_stats."""
        for name in ("postings", "terms", "documents", "stats"):
            self.table(name).createOrReplaceTempView(f"stored_{name}")
