"""Streams over `events`: windowed progress with a watermark, and a circuit breaker per key."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.folders import shared_folder


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an unbounded table, with a timestamp that watermarks take."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the stream so far, by one run over what is there. Windows go to a table as their state changes, one batch after
    the other; the last batch that has a window has its counts."""
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = windowed(source(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    latest = F.max_by(F.struct("n", "total"), "batch").alias("now")
    return spark.read.parquet(f"{folder}/out").groupBy("start", "event_type").agg(latest).select("start", "event_type", "now.n", "now.total")


def circuit_breaker(spark: SparkSession, sf_dir: str, limit: float = 150.0, pause: int = 60) -> DataFrame:
    """Per user: events in order, those within `pause` seconds of a value above the limit are refused. A user's events are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        closed_until, refused = -1, []
        for at, value in zip(pdf["at"], pdf["value"], strict=True):
            refused.append(at < closed_until)
            if not refused[-1] and value > limit:
                closed_until = at + pause
        return pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "refused": refused})

    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").cast("long").alias("at"))
    return table.groupBy("user_id").applyInPandas(run, "event_id long, user_id long, refused boolean")
