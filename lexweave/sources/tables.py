"""Columns that Python makes of distinct strings, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType


def with_words(df: DataFrame, column: str, name: str, function: Callable[[str], str]) -> DataFrame:
    """df with a further string column, made of a column of few distinct strings; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if w is None else function(w) for w in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, StringType()))
