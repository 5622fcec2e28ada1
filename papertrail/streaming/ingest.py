"""Incremental ingest: a stream of items, a durable state for each, outcomes that count once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "uri string, generation long, status string, attempts int, error string, batch long"


def items(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 25) -> DataFrame:
    """New files below path, each once: the stream's checkpoint is the watermark, and a new checkpoint starts over."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def outcomes(batch: DataFrame, process: Callable[[DataFrame], DataFrame], number: int) -> DataFrame:
    """State rows of a batch: process gives (uri, generation, status, error) with status done, failed or skipped_non_doc."""
    done = process(batch).select("uri", "generation", "status", "error")
    return done.select("uri", "generation", "status", (F.col("status") == "failed").cast("int").alias("attempts"), "error", F.lit(number).cast("long").alias("batch"))


def run(stream: DataFrame, process: Callable[[DataFrame], DataFrame], state_path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Process what is new. A batch's states replace those of the same batch, so that a repeated batch counts once; a batch
    that is interrupted leaves no states and is done again. The trigger is `availableNow` unless given."""

    def each(batch: DataFrame, number: int) -> None:
        first = batch.withColumn("_r", F.row_number().over(Window.partitionBy("uri").orderBy("generation"))).filter("_r = 1").drop("_r")
        outcomes(first, process, number).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def states(spark: SparkSession, state_path: str) -> DataFrame:
    """One row per item: the first batch that had it counts (insert, else ignore), as a later change does not queue it again."""
    every = spark.read.schema(STATE).parquet(state_path)
    return every.groupBy("uri").agg(F.min_by(F.struct("generation", "status", "attempts", "error"), "batch").alias("s")).select("uri", "s.*")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def unfiled(state: DataFrame, photos: DataFrame) -> DataFrame:
    """Finished items without a photo row: the backfill's work. Unreadable ones are filed as 'other' so that it ends."""
    return state.filter("status in ('done', 'skipped_non_doc')").join(photos.select("uri"), "uri", "left_anti")


def sessions(points: DataFrame, *, gap: str = "36 hours", late: str = "7 days") -> DataFrame:
    """The streaming form of trips: sessions of a user's points (ts timestamp), closed when `gap` has passed. An extra beside the batch operator."""
    return points.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("photos"), F.min("ts").alias("first"), F.max("ts").alias("last"))
