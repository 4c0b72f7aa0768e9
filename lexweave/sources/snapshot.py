"""Documents as JSON lines: a gzip snapshot that is written in pieces, and a scan that reads such files, plain or compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands where a line lacks a value.
DEFAULTS = {"lang": "und", "source": "unknown"}


def write_snapshot(docs: DataFrame, path: str, by: str = "doc_id", rows: int = 100_000) -> None:
    """One JSON object a row, gzip, files of at most `rows` rows, each with a range of `by` in order."""
    docs.repartitionByRange(by).sortWithinPartitions(by).write.option("compression", "gzip").option("maxRecordsPerFile", rows).mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, order: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """The rows of JSON lines under path; lines that are no objects have only nulls and are left out. With `key`, one row of each key: the
    first by `order`; rows without a key stay. Nulls and blanks take the defaults."""
    rows = spark.read.schema(schema).json(path)
    rows = rows.dropna("all")
    if key:
        whole = [c for c in rows.columns if c != key]
        first = F.min_by(F.struct(*whole), F.col(order) if order else F.xxhash64(*whole)).alias("row")
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "row.*").select(*rows.columns)
        rows = one.unionByName(rows.where(F.col(key).isNull()))
    own = DEFAULTS if defaults is None else defaults
    return rows.select(*(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(own[c])).alias(c) if c in own else F.col(c) for c in rows.columns))
