"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import at_end, kept, over_arrow, utf8, word_blocks

#: Items that one pass over the documents carries to the executors, and the bytes of their texts at most.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 64 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 22


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_known = _Words()
at_end.append(_known.clear)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words."""
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * _FACTOR + h[k : k + n]
    out ^= out >> np.uint64(31)
    return out * _FACTOR


class ContainmentIndex:
    """Items by MinHash sketch, in partitions by size.

    An item is a set of n shingles (its words in runs of `width`, or all its words if there are fewer). Items are put in
    partitions by the power of two of n. In a partition with largest n = u, an item's sketch is its k smallest shingle
    hashes (bottom-k MinHash), k being the number of shingles of which a text with containment `least` may lack
    u - ceil(least * u), plus one: so any text that holds the item holds one hash of its sketch at least, however long
    the text. Small sets thus find their long supersets without a signature of the latter, and no match is missed.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int, least: float) -> None:
        self.ids, self.shingles, self.hashes = [], [], []
        self.least, by_size = least, {}
        self.widths: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for key, raw in items:
            words = raw.lower().split()
            if not words:
                continue
            w = min(width, len(words))
            own = {b" ".join(words[i : i + w]) for i in range(len(words) - w + 1)}
            h = np.unique(shingle_hashes(words, w))
            by_size.setdefault((w, len(own).bit_length()), []).append((len(self.ids), h))
            self.ids.append(key)
            self.shingles.append(own)
            self.hashes.append(h)
        for (w, _), members in sorted(by_size.items()):
            bits, table = self.widths.setdefault(w, (np.zeros(1 << _FILTER, bool), {}))
            u = max(len(h) for _, h in members)
            k = u - math.ceil(least * u - 1e-9) + 1
            for i, h in members:
                bits[(h[:k] >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
                for x in h[:k].tolist():
                    table.setdefault(x, []).append(i)

    def search(self, raw: bytes) -> list[tuple[object, int, int]]:
        """(item, shingles shared, shingles of the item) for every item of which the text holds `least` or more."""
        shared: dict[int, set[bytes]] = {}
        for w, (bits, table) in self.widths.items():
            found: set[int] = set()
            for words in word_blocks(raw, w - 1):  # first all candidates, as an item may lie across blocks
                h = shingle_hashes(words, w)
                for x in h[bits[(h >> np.uint64(64 - _FILTER)).astype(np.int64)]].tolist():
                    found.update(table.get(x, ()))
            if not found:
                continue
            wanted = np.unique(np.concatenate([self.hashes[i] for i in found]))
            held: set[bytes] = set()
            for words in word_blocks(raw, w - 1):
                h = shingle_hashes(words, w)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                held.update(b" ".join(words[i : i + w]) for i in np.flatnonzero(wanted[at] == h).tolist())
            for i in found:
                shared[i] = self.shingles[i] & held
        return [(self.ids[i], len(s), len(self.shingles[i])) for i, s in sorted(shared.items()) if len(s) >= self.least * len(self.shingles[i]) - 1e-9]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The query set in blocks of a proven size: a pass over the documents carries one block."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).toLocalIterator():
        block.append((r["id"], bytes(r["text"])))
        size += len(block[-1][1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """(id, item, n_shared, n_item, containment) for every row of docs and item with containment >= least.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; containment is the share of an item's distinct shingles that
    the whole text holds. The items are a stated query set: they go to the executors in blocks of at most 50,000 items or
    64 MB, and each block is one pass over the documents without a shuffle. Every pair found by sketch is verified on
    the shingles themselves. Null and empty texts hold nothing, items without words are in nothing, items of fewer than
    `width` words count by their whole sequence; repeated rows and repeated items are reported each; other columns are
    not read, whatever their names; if either table is empty there are no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_shared long, n_item long"
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = kept(name, lambda: ContainmentIndex(sent.value, width, least))
            for b in batches:
                hits = [(i, *hit) for i, raw in enumerate(b.column(1).to_pylist()) for hit in index.search(raw)]
                at, item, shared, size = zip(*hits, strict=True) if hits else ((), (), (), ())
                columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(item), pa.array(shared, pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(item_type), *columns[2:]], names=["id", "item", "n_shared", "n_item"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema[item_id].dataType)
        part = rows.mapInArrow(over_arrow(found), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    names = (id_col, item_id if item_id != id_col else f"{item_id}_item")
    return out.select(F.col("id").alias(names[0]), F.col("item").alias(names[1]), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows that contain an item, all columns as they were, however they are named: a filter, one for
    each block of items.

    Null and empty texts contain nothing and stay, and so do rows with nulls in other columns if their text is clean;
    repeated rows are judged each, repeated items change nothing; an empty table of either kind changes nothing.
    """
    spark = docs.sparkSession
    for block in item_blocks(items, item_id, item_text):
        sent, name, at = spark.sparkContext.broadcast(block), uuid.uuid4().hex, docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, name=name, at=at) -> Iterator[pa.RecordBatch]:
            index = kept(name, lambda: ContainmentIndex(sent.value, width, least))
            for b in batches:
                keep = [t is None or not index.search(t.encode()) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(over_arrow(clean), docs.schema)
    return docs
