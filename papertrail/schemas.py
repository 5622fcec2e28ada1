"""Schemas of the engine's tables, and their earlier versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables and their columns.
TABLES = {
    "documents": "id long, source_uri string, source_kind string, sha256 string, vault_path string, doc_type string, doc_type_confidence float, doc_type_source string, title_en string, ocr_text string, scripts array<string>, captured_at timestamp, issued_on date, expiry_on date, expiry_source string, owner_name string, created_at timestamp, is_user_confirmed boolean, mime_type string, page_count int, dup_of_doc_id long, needs_llm int, source_missing boolean, ocr_engine string",
    "entities": "id long, doc_id long, kind string, value string, value_masked string, boxes array<struct<l:float,t:float,r:float,b:float>>, page int",
    "chunks": "id long, doc_id long, chunk_ix int, text string, vector array<float>",
    "image_vectors": "doc_id long, vector array<float>",
    "pages": "doc_id long, page int, width int, height int, lines array<struct<text:string,l:float,t:float,r:float,b:float,confidence:float>>",
    "reminders": "id long, doc_id long, fire_at timestamp, offset_days int, state string",
    "index_state": "uri string, generation long, relative_path string, mime_type string, taken_at long, status string, error string, doc_id long, gate_label string, gate_margin float, attempts int, updated_at long",
    "kv": "key string, value string",
    "photos": "uri string, category string, confidence float, taken_at long, relative_path string, lat double, lon double, faces int, doc_id long, trip_id long, vector array<float>, place string",
}
KEYS = {"documents": ["id"], "entities": ["id"], "chunks": ["doc_id", "chunk_ix"], "image_vectors": ["doc_id"], "pages": ["doc_id", "page"], "reminders": ["doc_id", "offset_days"], "index_state": ["uri"], "kv": ["key"], "photos": ["uri"]}


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Rows of an older version: columns that came later are null, others are dropped."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(TABLES[table])
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
