"""What the operators of this subpackage share: word rule, checkpoints, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_BLANK = {c: " " for c in range(9, 14)}
_TO_LOWER = {ord(u): lo for u, lo in zip(UPPER, LOWER, strict=True)}
_LOWER_AND_BLANK = _TO_LOWER | _TO_BLANK


def words(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return [w for w in text.translate(_LOWER_AND_BLANK).split(" ") if w] if text else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session. One is made only where the session names none and runs on this machine alone."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


#: Removes the shuffle files of a query when it ends; without it they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query that ends leaves no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before or "false")


#: Bytes of rows that go to and come from a Python worker at once.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Inside, long texts go to Python workers in batches of a few megabytes, whatever their number."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint: for narrow tables that several jobs read."""
    checkpoint_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: for wide tables of which jobs read some columns. by: a column with a
    folder for each of its values."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame, part: str = "") -> None:
    """Deletes tables that written() made, once nothing is left to read them. part: only the folder of that name in each."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if part in f}:
            path = hadoop.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


#: What empties the memory that modules keep in a worker process for tasks to come, by module.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(module: str, empty: Callable[[], None]) -> None:
    _remembered[module] = empty


def forget(but: str) -> None:
    """Empties what modules other than `but` have left in this worker process, which serves one stage of a pipeline after another."""
    for module, empty in _remembered.items():
        if module != but:
            empty()


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Rows from Arrow batches. make() is called once a task and gives the function from columns to columns; of what earlier tasks have
    left in the process only the memory of its own module is kept."""
    target: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)
    module = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(module)
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(one(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, target)
