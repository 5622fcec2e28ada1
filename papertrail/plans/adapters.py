"""The fixture tables as the engine's tables, in DataFrames and in SQL: both by the same deterministic mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.operators.vault import with_derived

TODAY = "2025-06-30"
ORDERS_TODAY = "2001-08-01"
PHOTO_OF = {"view": "places", "signup": "selfie", "click": "people", "error": "screenshot", "purchase": "food"}
STATUS_OF = {"view": "done", "signup": "pending", "click": "skipped_non_doc", "error": "failed", "purchase": "done"}
TYPE_OF_PRIORITY = {"1-URGENT": "AADHAAR", "2-HIGH": "PAN", "3-MEDIUM": "BANK_STATEMENT", "4-NOT SPECIFIED": "SALARY_SLIP", "5-LOW": "EMPLOYMENT_LETTER"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def millis(ts: str) -> Column:
    """Of a timestamp without zone: milliseconds since the epoch, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _nth(values: list[str], at: Column) -> Column:
    return F.element_at(F.lit(values), (at + 1).cast("int"))


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    captured = F.date_add(day("2024-01-01"), (d % 730).cast("int"))
    kind = _nth(dims.NAMES, d % 27)
    rows = table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.col("text").alias("ocr_text"),
        F.col("source").alias("owner_name"),
        _nth(["gallery", "camera", "pdf"], d % 3).alias("source_kind"),
        kind.alias("doc_type"),
        ((d % 100) / 100.0).alias("doc_type_confidence"),
        _nth(["rule", "image", "llm", "user"], d % 4).alias("doc_type_source"),
        F.concat(dims.label_of(kind), F.lit(" · "), F.col("source")).alias("title_en"),
        (d % 7 == 0).alias("is_user_confirmed"),
        captured.alias("captured_at"),
        F.when(d % 4 != 0, F.date_sub(captured, (d % 60).cast("int"))).alias("issued_on"),
        F.when(d % 5 == 0, F.date_add(captured, 365)).alias("expiry_on"),
        (d % 4).cast("int").alias("needs_llm"),
        F.when((d % 50 == 0) & (d > 0), d - 1).alias("dup_of_doc_id"),
    )
    return with_derived(rows, day(TODAY))


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(e.cast("string").alias("uri"), e.alias("generation"), dims.lookup(F.col("event_type"), STATUS_OF).alias("status"), millis("ts").alias("taken_at"), k.alias("attempts"), (e % 997).alias("updated_at"), "value")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, ms = F.col("event_id"), F.col("user_id"), millis("ts")
    away = F.when(F.floor(ms / 86_400_000) % 5 == 0, 1.5).otherwise(0.0)
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("uri"),
        e.alias("id"),
        u.alias("user_id"),
        dims.lookup(F.col("event_type"), PHOTO_OF).alias("category"),
        ms.alias("taken_at"),
        (10 + (u % 20) * 0.5 + away + (e % 7) * 0.001).alias("lat"),
        (70 + (u % 15) * 0.5).alias("lon"),
        F.when(e % 3 != 0, F.concat(F.lit("NATION_"), (u % 25).cast("string"))).alias("place"),
        F.when(e % 4 == 0, F.floor(ms / 86_400_000)).alias("trip_id"),
        F.when(e % 10 == 0, e).alias("doc_id"),
        F.concat(F.lit("DCIM/"), F.when(e % 11 == 0, F.lit("Screenshots/")).otherwise(F.lit("Camera/"))).alias("path"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("doc_id"), F.col("embedding").alias("vector"), "label")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per label: that of its first row."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.col("label").cast("string").alias("label"), F.col("label").alias("ordinal"), (F.col("label") < 5).alias("is_document"), _nth(dims.PHOTO_CATEGORIES, F.col("label") % 8).alias("category"), "vector")


def checklist_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    on = F.to_date("o_orderdate")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("owner"), dims.lookup(F.col("o_orderpriority"), TYPE_OF_PRIORITY).alias("effective_type"), on.alias("effective_date"), F.date_add(on, 365).alias("expiry_on"), (F.col("o_orderstatus") == "F").alias("confirmed"), F.round(F.col("o_totalprice") / 600_000.0, 6).alias("confidence"))


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_TYPES = "[" + ", ".join(f"'{n}'" for n in dims.NAMES) + "]"
_LABELS = "[" + ", ".join(f"'{t.label}'" for t in dims.DOC_TYPES) + "]"
VAULT = f"""
WITH v0 AS (
  SELECT doc_id AS id, text AS ocr_text, source AS owner_name, ['gallery', 'camera', 'pdf'][doc_id % 3 + 1] AS source_kind, {_TYPES}[doc_id % 27 + 1] AS doc_type,
    (doc_id % 100) / 100.0::DOUBLE AS doc_type_confidence, ['rule', 'image', 'llm', 'user'][doc_id % 4 + 1] AS doc_type_source, {_LABELS}[doc_id % 27 + 1] AS label,
    doc_id % 7 = 0 AS is_user_confirmed, DATE '2024-01-01' + (doc_id % 730)::INT AS captured_at, doc_id % 4 AS needs_llm,
    CASE WHEN doc_id % 50 = 0 AND doc_id > 0 THEN doc_id - 1 END AS dup_of_doc_id
  FROM documents
), v1 AS (
  SELECT *, CASE WHEN id % 4 <> 0 THEN captured_at - (id % 60)::INT END AS issued_on, CASE WHEN id % 5 = 0 THEN captured_at + 365 END AS expiry_on,
    is_user_confirmed OR doc_type_confidence >= 0.8 AS is_type_confident FROM v0
), vault AS (
  SELECT *, CASE WHEN is_type_confident THEN doc_type ELSE 'OTHER_DOCUMENT' END AS effective_type, coalesce(issued_on, captured_at) AS effective_date,
    coalesce(expiry_on < DATE '{TODAY}', false) AS expired FROM v1
)
"""
STATE = f"""
WITH state AS (
  SELECT event_id::VARCHAR AS uri, event_id AS generation, {_case("event_type", STATUS_OF)} AS status, epoch_us(ts) // 1000 AS taken_at, (props->>'$.k')::INT AS attempts, event_id % 997 AS updated_at, value
  FROM events
)
"""
PHOTOS = f"""
WITH photos AS (
  SELECT event_id::VARCHAR AS uri, event_id AS id, user_id, {_case("event_type", PHOTO_OF)} AS category, epoch_us(ts) // 1000 AS taken_at,
    10 + (user_id % 20) * 0.5::DOUBLE + CASE WHEN epoch_us(ts) // 86400000000 % 5 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + (event_id % 7) * 0.001::DOUBLE AS lat, 70 + (user_id % 15) * 0.5::DOUBLE AS lon,
    CASE WHEN event_id % 3 <> 0 THEN 'NATION_' || (user_id % 25) END AS place, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 86400000000 END AS trip_id,
    CASE WHEN event_id % 10 = 0 THEN event_id END AS doc_id, 'DCIM/' || CASE WHEN event_id % 11 = 0 THEN 'Screenshots/' ELSE 'Camera/' END AS path
  FROM events
)
"""
CHECKLIST = f"""
WITH docs AS (
  SELECT o_orderkey AS id, c_name AS owner, {_case("o_orderpriority", TYPE_OF_PRIORITY)} AS effective_type, o_orderdate::DATE AS effective_date, o_orderdate::DATE + 365 AS expiry_on,
    o_orderstatus = 'F' AS confirmed, round(o_totalprice / 600000.0, 6) AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""
