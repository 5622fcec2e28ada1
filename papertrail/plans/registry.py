"""Where queries are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    """Register a query; its dates come out as ISO text."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    QUERIES[f.__name__] = run
    return run


def oracle(f: Query, sql: str) -> None:
    """The SQL that a registered query is held against."""
    ORACLES[f.__name__] = sql
