"""Queries that SQL does not express: per-text procedures, resampling, factorisation, streams. Rows only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators import latent, pages, significance, spoken, text, timing, transcription
from lexweave.plans.registry import QUERIES, register
from lexweave.sources import snapshot
from lexweave.sources.folders import shared_folder
from lexweave.sources.index import Index, tokens
from lexweave.streaming import events


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sentence_rows(_read(spark, sf_dir, "documents"))


def _pieces(t: str | None) -> list[str]:
    return [(t or "")[a:b] for a, b in text.sentences(t)]


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text and the idf of its terms that the index has."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    terms = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    known = terms.join(Index.of(spark, sf_dir).table("terms").select("term", "idf"), "term").groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    return items.join(known, "item_id", "left")


def _textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = text.per_row(_weighted(spark, sf_dir), ["text", "weights"], lambda t, w: text.textrank(_pieces(t), dict(w or ())), "array<double>", "item_id")
    return ranks.select("item_id", F.posexplode("out").alias("i", "rank")).withColumn("rank", F.round("rank", 6))


def _mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    def choose(t: str | None, w) -> list[int]:
        parts = _pieces(t)
        ranks = text.textrank(parts, dict(w or ()))
        return text.mmr([r / max(ranks) for r in ranks], [set(text.tokens(p)) for p in parts], 3)

    chosen = text.per_row(_weighted(spark, sf_dir), ["text", "weights"], choose, "array<int>", "item_id")
    return chosen.select("item_id", F.posexplode("out").alias("place", "i"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by way of a gzip snapshot of JSON lines."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot(docs, path)
    return snapshot.read_snapshot(spark, path, docs.schema)


def _rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").withColumn("lead", F.substring_index("text", ".", 1))
    share = lambda t, lead: text.lcs(text.tokens(t or ""), text.tokens(lead or "")) / max(1, len(text.tokens(t or "")))
    return text.per_row(items, ["text", "lead"], share, "double", "item_id").withColumnRenamed("out", "rouge_l")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.per_row(_read(spark, sf_dir, "documents"), ["text"], lambda t: text.snippet(t, {"tion", "that", "with"})[0], "string", "doc_id")
    return found.withColumnRenamed("out", "snippet")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.per_row(_read(spark, sf_dir, "pages"), ["html", "url"], text.links, "array<string>", "page_id")
    return found.select("page_id", F.posexplode("out").alias("i", "link"))


def _digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").select(F.col("conv_id"), F.concat("text", F.lit(" go to section twenty one")).alias("text"))
    return text.per_row(table, ["text"], text.words_to_digits, "string", "conv_id").withColumnRenamed("out", "text")


def _paired(spark: SparkSession, sf_dir: str) -> list[float]:
    """Differences of two runs over the topics; there are few topics, by nature."""
    rows = QUERIES["q_topic_scores"](spark, sf_dir).select("query_id", "name", "ap").collect()
    of = {(r.name, r.query_id): r.ap for r in rows}
    return [of["bm25", q] - of["vector", q] for q in sorted({q for _, q in of}) if ("bm25", q) in of and ("vector", q) in of]


def _permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paired(spark, sf_dir)
    return spark.createDataFrame([("permutation", significance.permutation(d))], "test string, p double")


def _wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("wilcoxon", significance.wilcoxon(_paired(spark, sf_dir)))], "test string, p double")


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = significance.bootstrap(_paired(spark, sf_dir))
    return spark.createDataFrame([(low, high)], "low double, high double")


def _lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' places on three latent axes, and what share of the counts each axis explains."""
    counts = Index.of(spark, sf_dir).forward().select("doc_id", "term", "tf")
    loadings, _, shares = latent.axes(counts)
    return latent.folded(counts, loadings).select("doc_id", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")), *(F.lit(round(x, 9)).alias(f"share_{i}") for i, x in enumerate(shares)))


def _lsa_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items, which the axes weren't made from, folded in."""
    loadings, _, _ = latent.axes(Index.of(spark, sf_dir).forward().select("doc_id", "term", "tf"))
    items = tokens(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return latent.folded(items, loadings).select(F.col("doc_id").alias("item_id"), *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as it is read aloud, and how many stretches of it are said in other words."""

    def said(t: str | None) -> dict:
        own = spoken.speak(t)
        return {"spoken": own.text, "replaced": sum(words is not None for *_, words in spoken.stretches(t or "", spoken.Options()))}

    found = text.per_row(_read(spark, sf_dir, "documents"), ["text"], said, "struct<spoken: string, replaced: int>", "doc_id")
    return found.select("doc_id", "out.*")


def _transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of English documents in Cyrillic."""
    docs = _read(spark, sf_dir, "documents").where("lang = 'en'")
    return transcription.transcribed(docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("word")))


def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one spoken text whose turns are read in chunks: when its words are heard, if a word lasts as long as it has
    letters and the reader says digits by name."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    spoken = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("chunks"))
    spans = "array<struct<begin: int, stop: int, start: double, end: double>>"
    found = text.per_row(spoken, ["chunks"], timing.read_aloud, spans, "conv_id")
    return found.select("conv_id", F.posexplode("out").alias("i", "s")).select("conv_id", "i", "s.begin", "s.stop", F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"))


def _language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a multilayer perceptron over hashed character pairs, trained on even ids and told on odd ones."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import HashingTF, NGram, StringIndexer

    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", F.split(F.lower(F.coalesce("text", F.lit(""))), "").alias("chars"))
    pairs = HashingTF(inputCol="pairs", outputCol="features", numFeatures=128).transform(NGram(n=2, inputCol="chars", outputCol="pairs").transform(docs))
    labels = StringIndexer(inputCol="lang", outputCol="label").fit(pairs)
    data = labels.transform(pairs)
    model = MultilayerPerceptronClassifier(layers=[128, 16, len(labels.labels)], maxIter=30, seed=7).fit(data.where("doc_id % 2 = 0"))
    return model.transform(data.where("doc_id % 2 = 1")).select("doc_id", "lang", F.element_at(F.array(*map(F.lit, labels.labels)), F.col("prediction").cast("int") + 1).alias("guess"))


register("q_snapshot", _snapshot, "SELECT doc_id, text, coalesce(nullif(trim(lang), ''), 'und') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source FROM documents")
register("q_sentences", _sentences)
register("q_textrank", _textrank)
register("q_mmr", _mmr)
register("q_rouge_l", _rouge_l)
register("q_snippets", _snippets)
register("q_extract_links", _links)
register("q_words_to_digits", _digits)
register("q_permutation", _permutation)
register("q_wilcoxon", _wilcoxon)
register("q_bootstrap", _bootstrap)
register("q_lsa", _lsa)
register("q_spoken_text", _spoken)
register("q_transcribe", _transcribed)
register("q_lsa_project", _lsa_project)
register("q_align", _align)
register("q_mlp_lang", _language_model)
register("q_stream_progress", events.progress)
register("q_circuit_breaker", events.circuit_breaker)


#: Rules that stand for the robots files of the pages' hosts.
ROBOTS = "User-agent: *\nDisallow: /de/\nAllow: /\nCrawl-delay: 2"


def _over(table: str, columns: list[str], function, schema: str, keep: str, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text.per_row(_read(spark, sf_dir, table), columns, function, schema, keep).withColumnRenamed("out", name)

    return query


def _echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = _read(spark, sf_dir, "conversations").withColumn("played", before)
    return text.per_row(turns, ["text", "played"], pages.without_echo, "string", "conv_id").withColumnRenamed("out", "heard")


register("q_html_paragraphs", _over("pages", ["html"], pages.paragraphs, "array<string>", "page_id", "paragraphs"))
register("q_extract_main", _over("pages", ["html"], pages.main_text, "string", "page_id", "text"))
register("q_robots", _over("pages", ["url"], lambda url: pages.allowed(ROBOTS, url), "boolean", "page_id", "allowed"))
register("q_text_blocks", _over("documents", ["text"], pages.blocks, "array<struct<kind:string,text:string,level:int>>", "doc_id", "blocks"))
register("q_units", _over("benchmark", ["text"], pages.units, "array<string>", "item_id", "units"))
register("q_hash_features", _over("benchmark", ["text"], pages.hashed_grams, "array<struct<slot:int,value:double>>", "item_id", "features"))
register("q_echo", _echo)
