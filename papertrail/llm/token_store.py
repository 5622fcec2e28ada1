"""Token ids of a corpus in files of directly addressable codes, and their reading back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm import dac
from papertrail.llm.common import over_arrow, partitions, shared_dir, utf8
from papertrail.llm.tokens import vocabulary_path, word_encoder

#: A file closes after the document with which it reaches so many ids.
FILE_IDS = 1 << 20


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 2, shards: int | None = None) -> None:
    """Encode every text, append `end`, and write the ids in ascending id order below path.

    Rows are range-partitioned by id into shards and sorted there; each shard is a run of files of directly addressable
    codes (see dac.py), each of whole documents, with the ids and lengths of its documents beside it. A file is the binary
    value of a Parquet row, since only Spark's writers reach every store and only they make the output of a lost or
    repeated task appear once. Ties of the id are put in order of their text; null ids come first. A task holds one
    file's ids and a bounded memory of words.
    """
    vocab = vocabulary or vocabulary_path("word_bpe_49k.json")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = word_encoder(vocab), np.array([end], dtype="<u4").tobytes()
        ids: list[bytes] = []
        keys: list[int | None] = []
        first = held = shard = block = 0

        def closed() -> pa.RecordBatch:
            raw = dac.encode(np.frombuffer(b"".join(ids), dtype="<u4"))
            values = [[shard], [block], [first], [keys], [[len(x) // 4 for x in ids]], [raw]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])
        for b in batches:
            for shard, key, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(b.column(2).to_pylist()), strict=True):
                ids.append(own + last)
                keys.append(key)
                held += len(ids[-1]) // 4
                if held >= FILE_IDS:
                    yield closed()
                    first, held, block, ids, keys = first + held, 0, block + 1, [], []
        if ids:
            yield closed()

    n = shards or partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "id", "text")
    rows.mapInArrow(over_arrow(files), "shard int, block int, first long, ids array<bigint>, lengths array<bigint>, codes binary").write.parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """The files below path: shard, block, start (ids of all documents in files before it), ids, lengths, codes.

    What goes through the driver is one number for each shard, of which there are as many as shuffle partitions.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    before, at = [], 0
    for r in totals:
        before.append((r["shard"], at))
        at += r["n"]
    starts = spark.createDataFrame(before, "shard int, before long")
    return files.join(F.broadcast(starts), "shard").select("shard", "block", (F.col("before") + F.col("first")).alias("start"), "ids", "lengths", "codes")


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, keys, lengths, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                reader, at, starts, sums, ids = dac.Reader(raw), 0, [], [], []
                for n in lengths:
                    own = reader.slice(at, at + n).astype("<u4")
                    starts.append(start + at)
                    sums.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int64).tolist())
                    at += n
                columns = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names=names)

    names = ["id", "start", "n_tokens", "ids_crc32"] + (["token_ids"] if with_ids else [])
    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<bigint>" if with_ids else "")
    return token_index(spark, path).select("start", "ids", "lengths", "codes").mapInArrow(over_arrow(rows), schema).withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 2) -> DataFrame:
    """Write docs with write_tokens() to the shared folder and read them back with read_tokens().

    Null and empty texts are the end id alone. Repeated rows are written each. Other columns are not read, whatever
    their names. An empty table gives no files and no rows.
    """
    path = f"{shared_dir(docs.sparkSession)}/papertrail-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end=end)
    return read_tokens(docs.sparkSession, path, id_col=id_col)
