"""Sinks: many tables for one batch of documents, idempotent by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail import schemas


MANIFEST = "batch_id long, attempt string, at timestamp, tables array<string>"


def write_batch(tables: dict[str, DataFrame], path: str, batch: int) -> None:
    """All tables of a batch below path as one unit: readers see all of it or nothing.

    Each table goes to a folder of its own for this attempt, which nobody reads yet. When all are there, one line of the
    manifest names the attempt: that file, which appears at once, is the commit. An attempt that ends before leaves what
    was there as it was. A batch that is written again replaces its last commit, so that it counts once.
    """
    attempt, spark = uuid.uuid4().hex, next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/batch_id={batch}/attempt={attempt}")
    line = spark.range(1).select(F.lit(batch).cast("long").alias("batch_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"), F.lit(sorted(tables)).alias("tables"))
    line.write.mode("append").parquet(f"{path}/manifest")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, attempt, tables): the last commit of each batch."""
    lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return lines.groupBy("batch_id").agg(F.max_by(F.struct("attempt", "tables"), F.struct("at", "attempt")).alias("c")).select("batch_id", "c.*")


def read_table(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of a table that commits name; folders of other attempts aren't read."""
    rows = spark.read.schema((schema or schemas.TABLES[name]) + ", batch_id long, attempt string").parquet(f"{path}/{name}")
    named = commits(spark, path).filter(F.array_contains("tables", name)).select("batch_id", "attempt")
    return rows.join(named, ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")


def abandoned(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(batch_id, attempt): attempts at a table that no commit names (any more), to be deleted."""
    there = spark.read.schema("batch_id long, attempt string").parquet(f"{path}/{name}").select("batch_id", "attempt").distinct()
    return there.join(commits(spark, path).select("batch_id", "attempt"), ["batch_id", "attempt"], "left_anti")


def orphans(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored files that no document names."""
    return files.join(documents.select(F.col("vault_path").alias("path")), "path", "left_anti")
