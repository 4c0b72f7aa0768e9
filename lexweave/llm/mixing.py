"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Targets: the sources, by code point with null last, get weights and share the mix by weight; a source's target stops at
`repeats` times its size and the excess is shared again by weight: the level at which the targets fill the mix, in closed form.

Order: each source has a weight schedule over training time 0 to 1, linear between knots. Its integral says how much of the
target is due by any time; inverting it turns a document's place in its source's word stream into a training position. A source's
stream is its documents in the order of md5(doc_id), repeated from the start until the target is reached, where the last document
may be taken in part. Prefix sums are made within (source, hash bucket) and over buckets, so that no task holds a whole source.

Null texts have size 0; a null source is a source; a very long text is one document of its size; a row without an id is placed by its
text; equal keys fall by id and size; repeated rows are documents of their own, each taken as often as its own place in the stream says.
An empty table gives an empty mix.
Columns other than doc_id, text and source are left aside by `assign`; `mix` keeps the columns of its input. The plan of targets has a
row a source: up to `BROADCAST` sources it is broadcast, and where there are more it is joined by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import WORD, cut, documents

WEIGHTS, REPEATS = (5, 2, 1), 3
#: Knots (time, weight) of the schedule that goes with each weight: the heavy sources fade, the light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hash buckets of a source; one task sorts one bucket, a 4096th of a source.
BUCKETS = 4096
#: As many sources as this are broadcast with their targets, 20 MB at most.
BROADCAST = 100_000


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """src, source_size, target and segments, from (src, source, size). One row a source: this table is small by nature."""
    sources = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.get(F.array(*values), F.col("_place") % len(values))
    sources = sources.withColumn("_place", place).withColumn("_weight", pick([F.lit(w) for w in weights]))
    by_cap = Window.orderBy((F.lit(repeats) * F.col("source_size")) / F.col("_weight"), "_place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    free = F.sum("source_size").over(Window.partitionBy()) - F.lit(repeats) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sources = sources.withColumn("_level", free / F.sum("_weight").over(after))
    level = F.max("_level").over(Window.partitionBy())
    target = F.least(F.lit(repeats) * F.col("source_size"), F.col("_weight") * level).cast("double")
    return sources.withColumn("target", target).select("src", "source_size", "target", pick([_segments(s) for s in schedules]).alias("segments"))


def _segments(knots: tuple[tuple[float, float], ...]) -> Column:
    """The stretches between knots: start, weight there, slope, and the share of the whole that is due before."""
    stretches = list(zip(knots, knots[1:], strict=False))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in stretches)
    due, out = 0.0, []
    for a, b in stretches:
        out.append(F.struct(F.lit(a[0]).alias("t"), F.lit(a[1] / whole).alias("w"), F.lit((b[1] - a[1]) / (b[0] - a[0]) / whole).alias("slope"), F.lit(due).alias("due")))
        due += (b[0] - a[0]) * (a[1] + b[1]) / 2 / whole
    return F.array(*out)


def time_of(share: Column, segments: Column) -> Column:
    """The training time by which a share of the target is due: the inverse of the integrated schedule."""
    s = F.element_at(F.filter(segments, lambda x: (x["due"] <= share) | (x["due"] == 0)), -1)
    rest = share - s["due"]
    root = s["w"] + F.sqrt(F.greatest(F.lit(0.0), s["w"] * s["w"] + 2 * s["slope"] * rest))
    return F.when(root > 0, s["t"] + 2 * rest / root).otherwise(s["t"])


def sized(docs: DataFrame, *more: Column, text: str = "text", source: str = "source") -> DataFrame:
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(F.concat(F.lit("="), F.col(text))))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col(source).alias("source"), source_key(F.col(source)).alias("src"), size.alias("size"), F.coalesce(key, F.lit("")).alias("key"), *more)


def assign(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, repeats: int = REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken and the training position of the document's first copy, sorted by position."""
    return _assigned(cut(sized(docs)), weights, schedules, repeats, buckets).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), F.md5(F.col("doc_id").cast("string").cast("binary")))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(0)) * buckets / F.lit(1 << 32)).cast("int"))


def _assigned(sizes: DataFrame, weights: tuple[int, ...], schedules: tuple, repeats: int, buckets: int, rows: DataFrame | None = None) -> DataFrame:
    """The rows, `sizes` themselves unless given with more columns, and their places: what stands before, what is taken, and when."""
    sums = _bucketed(sizes, buckets).groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = _bucketed(sizes if rows is None else rows, buckets).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    plan = cut(targets(sizes, weights, schedules, repeats))
    if plan.count() <= BROADCAST:
        plan = F.broadcast(plan)
    placed = placed.join(offsets, ["src", "bucket"]).join(plan, "src").withColumn("before", F.col("offset") + F.col("inside"))
    before, whole, due = F.col("before"), F.col("source_size"), F.floor("target").cast("long")
    turns = F.when(whole > 0, F.floor(due / whole)).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), due - turns * whole - before))
    taken = turns * F.col("size") + part
    share = F.least(F.lit(1.0), before / F.col("target"))
    return placed.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, F.round(time_of(share, F.col("segments")), 9)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, repeats: int = REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """The documents of the mix with the columns of docs, each as often as it is taken, in the order of training. A document of
    which only a part is due is given whole where that part is half of it or more; one without words is not in the mix. The rows are
    placed with all their columns, so that no row has to be found again by its id."""
    whole = sized(docs, F.struct("*").alias("row")).where("size > 0")
    rows = _assigned(cut(sized(docs)), weights, schedules, repeats, buckets, whole)
    rows = rows.withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("copies > 0")
    rows = rows.select("row", "segments", "source_size", "target", "before", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    share = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before")) / F.col("target"))
    return rows.orderBy(time_of(share, F.col("segments")), F.xxhash64("row.doc_id"), "copy").select("row.*")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(CAST(doc_id AS VARCHAR)), md5('=' || text), '') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS i FROM s),
w AS (SELECT *, CASE i WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             CASE i WHEN 0 THEN -0.5e0 WHEN 1 THEN 0e0 ELSE 0.5e0 END AS a FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(CAST(sum(source_size) OVER b AS DOUBLE), 0)) / CAST(sum(weight) OVER f AS DOUBLE) AS lvl
      FROM w WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    f AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, a, least(CAST(3 * source_size AS DOUBLE), weight * max(lvl) OVER ()) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, CAST(floor(t.target) AS BIGINT) AS due,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS turns FROM c),
g AS (SELECT *, CAST(turns * size + greatest(0, least(size, due - turns * source_size - bef)) AS BIGINT) AS taken,
             least(1e0, bef / nullif(target, 0)) AS y FROM e)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * y / ((1 - a) + sqrt(greatest(0e0, (1 - a) * (1 - a) + 2 * (2 * a) * y))), 9) END AS position
FROM g
"""
