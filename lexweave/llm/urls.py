"""URL filters: path rules first, then trust and distrust spread over the links between hosts, in DataFrame operations only.

A rule such as `org/` or `example.org/es/` fits its host and all subdomains where the URL's path starts with the rule's; the
longest wins, then the first by text. Pages that an allow rule fits make their host a trusted seed, pages that a block rule fits a
blocked one, in proportion to their number. Trust is personalised PageRank along links; distrust runs against them, from the
linked host to the linking one. A host's score is trust / (trust + distrust); pages without a rule are blocked where it is below
`threshold`, and allowed where it is not or where neither reached the host.

Pages of a host that has more than a `SHARE`th of all pages are dealt to several tasks, and what is known of the host goes to each:
there are fewer than `SHARE` such hosts, so their list is broadcast. After 12 rounds at most 0.85 ** 12 = 0.14 of the rank has still
to spread.

Very long pages are read whole by one regular expression, one row at a time. Null URLs, or those without `://`, have an empty host and path; null pages link nowhere; each page row gives one row, repeated rows
repeated ones; an empty table gives an empty result; columns other than page_id, url and html are left aside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import LOWER, UPPER, ascii_lower, cut

#: Fixed rules of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
SHARE = 1024
#: Rounds between checkpoints.
CUT_EVERY = 4
#: More rules than this are joined by shuffling.
BROADCAST_RULES = 20_000
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(spark: SparkSession, hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host and its rules: array<struct<rule,path,verdict>>, for the hosts that have any."""
    rows = [(r, *r.partition("/")[::2], v) for v, r in rules]
    table = spark.createDataFrame([(r, h, "/" + p, v) for r, h, p, v in rows], "rule string, at string, path string, verdict string")
    if len(rows) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = F.split("host", r"\.", -1)
    ends = hosts.select("host", F.posexplode(labels).alias("i", "_"))
    ends = ends.select("host", F.array_join(F.slice(labels, F.col("i") + 1, F.size(labels)), ".").alias("at"))
    return ends.join(table, "at").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rule", "path", "verdict"))).alias("rules"))


def hot_hosts(hosts: DataFrame) -> DataFrame:
    """host, salts of the hosts with more than a SHARE-th of all pages, from (host, count): fewer than SHARE rows."""
    whole = F.broadcast(hosts.agg(F.sum("count").alias("whole")))  # one row
    return hosts.join(whole).where(F.col("count") * SHARE > F.col("whole")).select("host", F.ceil(F.col("count") * SHARE / F.col("whole")).cast("int").alias("salts"))


def joined_by_host(pages: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """pages with the columns of `known`, one row a host, where there are any. Pages of hot hosts are dealt by their id and path."""
    salts = lambda df: df.join(F.broadcast(hot), "host", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    pages = salts(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.col("salts")).cast("int")).drop("salts")
    known = salts(known).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return pages.join(known, ["host", "salt"], "left").drop("salt")


def best_rule(rules: Column, path: Column) -> Column:
    """The rule of the host that fits the path: the longest, then the first by text; null where none fits."""
    fits = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("less"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.get(ranked, 0)


def link_edges(pages: DataFrame) -> DataFrame:
    """source, target, n: links from a host to another, counted. Links within a host carry nothing."""
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("link"))
    target = ascii_lower(F.regexp_extract("link", r"//([^/?#]*)", 1))
    return links.select("source", target.alias("target")).where("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust from host, trust, distrust of the seeds: personalised PageRank along and against the edges."""
    seeds = cut(seeds)
    base = seeds.select("host", *(((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust")))
    if edges.isEmpty():  # nothing spreads
        return base
    out = edges.groupBy("source").agg(F.sum("n").alias("out"))
    into = edges.groupBy("target").agg(F.sum("n").alias("into"))
    shares = cut(edges.join(out, "source").join(into, "target").select("source", "target", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")))
    ranks = base
    for turn in range(rounds):
        trust = shares.join(ranks.withColumnRenamed("host", "source"), "source").select(F.col("target").alias("host"), (damping * F.col("trust") * F.col("forth")).alias("trust"), F.lit(0.0).alias("distrust"))
        against = shares.join(ranks.withColumnRenamed("host", "target"), "target").select(F.col("source").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") * F.col("back")).alias("distrust"))
        ranks = base.unionByName(trust).unionByName(against).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (turn + 1) % CUT_EVERY == 0:
            ranks = cut(ranks)
    return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's score."""
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut(parsed.groupBy("host").count())
    hot = cut(hot_hosts(hosts))
    ruled = host_rules(spark, hosts.select("host"), rules)
    best = joined_by_host(parsed, ruled, hot).select("page_id", "host", "path", best_rule(F.col("rules"), F.col("path")).alias("best"))
    best = cut(best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled")))
    counts = best.where("rule IS NOT NULL").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    whole = counts.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    seeds = counts.join(F.broadcast(whole)).select("host", part("good", "all_good").alias("trust"), part("bad", "all_bad").alias("distrust"))
    ranks = propagated(seeds, cut(link_edges(pages.select("url", "html"))))
    score = F.round(F.col("trust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), 9)
    scored = joined_by_host(best, ranks.select("host", score.alias("score")), hot)
    verdict = F.coalesce("ruled", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rounds(rounds: int) -> str:
    """The rounds of PageRank as common table expressions, r0 to r{rounds}."""
    d, out = DAMPING, [f"r0 AS (SELECT host, {1 - DAMPING}::DOUBLE * trust AS trust, {1 - DAMPING}::DOUBLE * distrust AS distrust FROM seeds)"]
    for i in range(rounds):
        out.append(
            f"r{i + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM r0 "
            f"UNION ALL SELECT e.target, {d}::DOUBLE * r.trust * e.forth, 0 FROM shares e JOIN r{i} r ON r.host = e.source "
            f"UNION ALL SELECT e.source, 0, {d}::DOUBLE * r.distrust * e.back FROM shares e JOIN r{i} r ON r.host = e.target) GROUP BY host)"
        )
    return ",\n".join(out)


_VALUES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for v, r in RULES)
OP3_SQL = rf"""
WITH rules(rule, rhost, start, ruled) AS (VALUES {_VALUES}),
p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hp AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, rule, ruled, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) AS i
      FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, start)),
b AS (SELECT p.page_id, p.host, p.path, m.rule, m.ruled FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.i = 1),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM b WHERE rule IS NOT NULL GROUP BY host),
seeds AS (SELECT host, coalesce(good / nullif(CAST(sum(good) OVER () AS DOUBLE), 0), 0) AS trust, coalesce(bad / nullif(CAST(sum(bad) OVER () AS DOUBLE), 0), 0) AS distrust FROM c),
links AS (SELECT host AS source, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1, 'i'))) AS link FROM p),
t AS (SELECT source, translate(regexp_extract(link, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS target FROM links),
edges AS (SELECT source, target, count(*) AS n FROM t WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL),
shares AS (SELECT source, target, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS forth, n / CAST(sum(n) OVER (PARTITION BY target) AS DOUBLE) AS back FROM edges),
{_rounds(ROUNDS)},
s AS (SELECT host, round(trust / nullif(trust + distrust, 0), 9) AS score FROM r{ROUNDS})
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.ruled, CASE WHEN s.score < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, s.score
FROM b LEFT JOIN s ON s.host = b.host
"""
