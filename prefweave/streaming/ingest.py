"""Resumable ingestion of score logs, as a file stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder of JSON lines, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest_scores(stream: DataFrame, key: str = "row_index", at: str = "scored_at", late: str = "2 days") -> DataFrame:
    """Each key once within the time that repeats may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_stats(stream: DataFrame, at: str, value: str, width: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Count and mean by time window, closed once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean")


def ingest(stream: DataFrame, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Append what is new to ``table`` and stop; run again, it goes on where it stopped.

    Every batch is written to a folder of its number, so that a batch that is run again after
    a failure replaces itself. Returns the number of batches.
    """
    seen = []

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")
        seen.append(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)


def gapless(df: DataFrame, key: str = "row_index") -> DataFrame:
    """(rows, next_index, gapless): may work go on at ``next_index``?"""
    return df.agg(F.count_distinct(key).alias("rows"), F.coalesce(F.max(key) + 1, F.lit(0)).alias("next_index")).withColumn("gapless", F.col("rows") == F.col("next_index"))
