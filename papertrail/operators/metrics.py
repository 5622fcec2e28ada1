"""Measures: latencies, outcomes, hits among the first three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 500


def latency(samples: DataFrame, *, series: str, value: str, newest: list[Column]) -> DataFrame:
    """(series, n, p50, p95, avg, last) over the last 500 samples; the p-th is at floor((n - 1) p)."""
    w = Window.partitionBy(series).orderBy(*newest)
    kept = samples.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= SAMPLES)
    g = kept.groupBy(series).agg(F.sort_array(F.collect_list(value)).alias("v"), F.avg(value).alias("avg"), F.min_by(value, "_r").alias("last"))
    at = lambda p: F.element_at("v", F.floor((F.size("v") - 1) * p).cast("int") + 1)
    return g.select(series, F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), "avg", "last")


def hit_at(ranked: DataFrame, expected: DataFrame, *, by: list[str], k: int = 3) -> DataFrame:
    """Share of cases with an expected label among the first k results, in whole per cent, by group and over all."""
    hits = ranked.filter(F.col("rank") <= k).join(expected, "case_id").groupBy("case_id").agg(F.max((F.col("got") == F.col("expected")).cast("int")).alias("hit"))
    cases = expected.select("case_id", *by).distinct().join(hits, "case_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return cases.rollup(*by).agg(F.count("*").alias("cases"), F.sum("hit").alias("hits"), F.floor(F.sum("hit") * 100 / F.count("*")).alias("percent"))


def throughput(items: DataFrame, *, status: str, remaining: str = "pending", ms: Column) -> DataFrame:
    """(done, failed, remaining, ms_per_item, eta_ms)."""
    n = lambda ok: F.sum(F.when(ok, 1).otherwise(0)).cast("long")
    out = items.agg(n(F.col(status) == "done").alias("done"), n(F.col(status) == "failed").alias("failed"), n(F.col(status) == remaining).alias("remaining"), F.avg(F.when(F.col(status) != remaining, ms)).alias("ms_per_item"))
    return out.withColumn("eta_ms", F.col("ms_per_item") * F.col("remaining"))
