"""Filter interaction audit by Walsh-Hadamard sums, in DataFrame operations only.

Each document has a mask of the filters that it fails. Per part and label (all, good, toxic) the documents' 32 signed parity sums
W(S) = sum of (-1)^|mask & S| are added up, a fixed number of longs however many documents there are; the transform is its own inverse
but for a division by 32, so the count of every mask comes back exactly. All that the audit asks is a sum over masks then: a filter
removes in an order the masks that hold it and none before it, and of a document that fails k filters each is the first in 120 / k of
the 120 orders, which gives the Shapley value without walking them.

Filters A to D are of the text alone, so equal texts share them; E needs only the smallest id of a text. Rows are therefore counted by
(id, text hash) before labels are joined and by (text hash, part, label) after it, and no task ever holds the rows of one text.

Null texts are empty ones: they fail A, and E where a smaller id is empty too. A null id is neither smaller nor larger than another, so
it fails E never, and it has no label. Rows that share their id and text don't fail E by each other and count each. An id has a label
if any of its label rows says so. Very long texts are read whole; ties don't arise; an empty table gives no row, as there is no part.
Columns other than doc_id, text and lang are ignored; a null lang is the part '', with those whose lang is ''.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import WORD, documents

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
LABELS = ("n", "good", "toxic")
FEW, UPPER_PERCENT, DISTINCT_PERCENT = 200, 3, 50


def text_mask(text: Column) -> Column:
    """Which of A to D a text fails, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = F.size(words) < FEW
    same = 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text)
    signs = text.rlike(r"[#$%&*|]")
    return sum(fails.cast("int") * (1 << i) for i, fails in enumerate((few, same, loud, signs)))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, quality, toxic, mask, n: how many documents have the mask; several rows of one kind may come."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_key"), text_mask(text).cast("int").alias("mask"))
    rows = rows.groupBy("doc_id", "part", "text_key", "mask").agg(F.count("*").alias("n"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(said("quality"), said("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    kind = ["text_key", "part", "quality", "toxic", "mask"]
    with_id = F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)
    rows = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(with_id).alias("with_id"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("text_key"))  # a row for each part and label of a text
    rows = rows.withColumn("again", F.col("with_id") - F.when(first, F.col("at_least")).otherwise(0))
    cases = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("again")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("again").alias("n"))))
    return rows.select("part", "quality", "toxic", cases.alias("case")).select("part", "quality", "toxic", "case.*").where("n > 0")


def sign(mask: Column, chosen: int) -> Column:
    return 1 - 2 * F.bit_count(mask.bitwiseAND(F.lit(chosen))).bitwiseAND(F.lit(1))


def over_masks(of: str) -> str:
    """SQL of the sum of a long that is told by the mask m, over the 32 masks."""
    return f"aggregate(sequence(0, {len(MASKS) - 1}), 0L, (_sum, m) -> _sum + {of})"


def cells(cases: DataFrame) -> DataFrame:
    """part and, for each label, an array of 32 counts by mask: parity sums, inverted."""
    held = {"n": F.col("n"), "good": F.when(F.col("quality"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = cases.groupBy("part").agg(*(F.array(*(F.sum(held[k] * sign(F.col("mask"), s)) for s in MASKS)).alias(k) for k in LABELS))
    back = lambda k: F.expr(f"transform(sequence(0, {len(MASKS) - 1}), c -> {over_masks(f'(1 - 2 * (bit_count(c & m) & 1)) * {k}[m]')} div {len(MASKS)})")
    return sums.select("part", *(back(k).alias(k) for k in LABELS))


#: A step's own filter and those before it as bits; what it finds is a sum over the masks.
FACTS = {
    "kept": "if(m & (own | earlier) = 0, n[m], 0L)",
    "removed": "if(m & own > 0 AND m & earlier = 0, n[m], 0L)",
    "redundant": "if(m & own > 0 AND m & earlier > 0, n[m], 0L)",
    "unique_fails": "if(m = own, n[m], 0L)",
    "good_lost": "if(m & own > 0 AND m & earlier = 0, good[m], 0L)",
    "toxic_lost": "if(m & own > 0 AND m & earlier = 0, toxic[m], 0L)",
    "shapley": "if(m & own > 0, 120 div bit_count(m) * n[m], 0L)",
}


def audited(cell: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        steps += [f"struct('{name}' AS filter_order, {k + 1} AS step, {1 << f} AS own, {sum(1 << x for x in order[:k])} AS earlier)" for k, f in enumerate(order)]
    rows = cell.select("*", F.expr(f"inline(array({', '.join(steps)}))"))
    return rows.select("part", "filter_order", "step", *(F.expr(over_masks(f"({of})")).alias(k) for k, of in FACTS.items()))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(cells(counted(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part,
         [len(w) < 200,
          100 * len(list_distinct(w)) < 50 * len(w),
          100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM d),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, array_to_string([substr('ABCDE', x, 1) FOR x IN ord], '') AS filter_order, i AS step FROM o, l),
h AS (
  SELECT part, filter_order, step, ord[step] AS own, n, good, toxic,
         fails[ord[step]] AS failing,
         len([x FOR x IN ord[1:step - 1] IF fails[x]]) > 0 AS gone,
         len([x FOR x IN fails IF x]) AS failures
  FROM g, s),
r AS (
  SELECT part, filter_order, step, own,
         CAST(sum(n) FILTER (NOT failing AND NOT gone) AS BIGINT) AS kept, CAST(sum(n) FILTER (failing AND NOT gone) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (failing AND gone) AS BIGINT) AS redundant, CAST(sum(n) FILTER (failing AND failures = 1) AS BIGINT) AS unique_fails,
         CAST(sum(n) FILTER (failing AND NOT gone AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (failing AND NOT gone AND toxic) AS BIGINT) AS toxic_lost
  FROM h GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
