"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow
from papertrail.llm.tokens import piece_counter, vocabulary_path


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    n_tokens is what the sentencepiece library gives for the whole text, without begin or end tokens; n_bytes the
    text's length in UTF-8. One pass over the table, no shuffle; a task holds a batch of texts and a bounded memory of
    pre-tokens. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each;
    other columns are not read, whatever their names; an empty table gives no rows.
    """
    path = model or vocabulary_path("piece_bpe_32k.model")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for b in batches:
            n = [counter.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(over_arrow(counted), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
