"""A corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; run()
writes it as Parquet to the shared folder and reads it again as the next one's docs. All stages but the last return the
columns of documents. An empty table, nulls, repeated rows and further columns pass as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papertrail.llm import langid
from papertrail.llm.common import forget, stored
from papertrail.llm.decontam import drop_contaminated
from papertrail.llm.exact_dedup import drop_exact
from papertrail.llm.packing import pack
from papertrail.llm.queries import fold
from papertrail.llm.simhash import drop_near
from papertrail.storage import mark


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: those that are null, empty or without a letter go (`und`)."""
    learned = langid.labelled_sample(docs, fold("doc_id", 3) != 1, text_col="text", lang_col="lang")
    return langid.identify(docs, learned, keep=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item: 0.8 or more of an item's five-word shingles."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 2,048 tokens."""
    return pack(docs, with_ids=False, lean=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express cross-parsing, SimHash clustering, tokenization or differencing: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; on disk are a stage's rows and what it needs for them, and of the one before it only its rows."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        forget(spark, first, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
