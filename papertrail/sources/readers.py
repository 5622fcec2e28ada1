"""Sources: tables, dictionaries, images, pages of PDFs, coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail import dims, schemas

MAX_PAGES = 30


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as it is stored, with its schema given, never inferred."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{path}/{name}")


def changed_since(items: DataFrame, watermark: int, *, version: str, last_version: str | None) -> DataFrame:
    """Items whose generation is above the watermark, in its order; all of them if the store's version is another."""
    floor = watermark if version == last_version else 0
    return items.filter(F.col("generation") > floor)


def next_watermark(items: DataFrame, watermark: int) -> DataFrame:
    return items.agg(F.coalesce(F.max("generation"), F.lit(watermark)).alias("watermark"))


def queue(state: DataFrame, n: int = 25) -> DataFrame:
    """The next pending items."""
    return state.filter("status = 'pending'").orderBy("generation", "uri").limit(n)


def places(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, population) from tab-separated lines; comments, blank lines and short lines are left out, a bad population is 0."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(parts) >= 4))
    number = lambda i, kind: F.expr(f"try_cast(split(value, '\\t')[{i}] AS {kind})")
    return rows.select(parts[0].alias("name"), number(1, "double").alias("lat"), number(2, "double").alias("lon"), F.coalesce(number(3, "long"), F.lit(0).cast("long")).alias("population")).filter("lat is not null and lon is not null")


def checklist_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from a JSON file: {"templates": [{"id", "items": [{"doc_type", "count", "optional", "recency": {"rule", "months"}}]}]}."""
    schema = "templates array<struct<id:string,items:array<struct<doc_type:string,count:int,min:int,optional:boolean,recency:struct<rule:string,months:int>>>>>"
    items = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("templates").alias("t")).select(F.col("t.id").alias("template"), F.posexplode("t.items").alias("position", "i"))
    return items.select("template", "position", "i.doc_type", F.coalesce("i.count", F.lit(1)).alias("n"), F.coalesce("i.optional", F.lit(False)).alias("optional"), F.col("i.recency.rule").alias("rule"), F.coalesce("i.recency.months", F.lit(0)).alias("months"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, lang string, query string, expect_types array<string>, expect_template string").json(path, multiLine=True)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes: (path, modificationTime, length, content). Their decoding is an injected function's."""
    return spark.read.format("binaryFile").load(path)


def pages_of(files: DataFrame, render: Callable[[bytes], list[str]], *, most: int = MAX_PAGES) -> DataFrame:
    """(path, page, text, error): a row for each page that `render` makes of a file, at most 30; a file that it refuses is one row with the error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(render(content)[:most])]
                except Exception as e:  # noqa: BLE001  a typed result, as for encrypted files
                    out.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(rows, "path string, page int, text string, error string")


def coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(0, 0) stands for no coordinates."""
    none = (lat == 0) & (lon == 0)
    return F.when(~none, lat), F.when(~none, lon)


def adhoc(spark: SparkSession, content: bytes, *, uri: str, expected: str | None = None) -> DataFrame:
    """One file that a user picked, with the type it is expected to be."""
    return spark.createDataFrame([(uri, bytearray(content), expected if expected in dims.BY_NAME else None)], "uri string, content binary, expected_type string")


def kv_map(kv: DataFrame, key: str) -> DataFrame:
    """A value of `k=v` lines as rows (k, v)."""
    lines = kv.filter(F.col("key") == key).select(F.explode(F.str_to_map("value", F.lit("\n"), F.lit("="))).alias("k", "v"))
    return lines.filter("k <> '' and v is not null")


def kv_ids(kv: DataFrame, key: str) -> DataFrame:
    """A value of comma-separated ids as rows (id)."""
    ids = kv.filter(F.col("key") == key).select(F.explode(F.split("value", ",")).alias("x"))
    return ids.select(F.expr("try_cast(trim(x) AS long)").alias("id")).filter("id is not null")
