"""Streams of records: once-only delivery, windows, and means of every N steps. Each has a batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.plans.lineage import checkpoint_dir, drop_at_end


def once(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first delivery of each key; keys are forgotten when ``late`` has gone by, so state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, width: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    """Aggregates per tumbling window; records later than ``late`` are left out."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(*aggs)
    return g.select(F.col("window.start").alias("start"), *(c for c in g.columns if c != "window"))


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """(by..., start, stop, n) of runs of records no farther apart than ``gap``."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def step_means(df: DataFrame, step: str, every: int, values: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., part, steps, means): values averaged over every ``every`` steps; the same on a stream and a table."""
    return df.groupBy(*by, F.floor(F.col(step) / every).alias("part")).agg(F.count("*").alias("steps"), *(F.avg(v).alias(v) for v in values))


def follow_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files that match ``path`` (a glob); the schema is that of what is there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """Runs an appending stream over all that is there, into a table in the shared folder, and gives that table. It and the stream's state are dropped when the program ends."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/rows")
    q.awaitTermination()
    drop_at_end(spark, at)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
