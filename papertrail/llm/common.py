"""What several corpus operators share: storage on the cluster's shared folder, word streams, membership words."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.storage import forget, shared_dir, stored

__all__ = ["at_end", "fold_case", "forget", "join_groups", "kept", "membership", "over_arrow", "partitions", "shared_dir", "stored", "utf8", "whole_row", "with_suspects", "without", "word_blocks"]

T = TypeVar("T")

#: A membership table has at most 2**20 rows of 64 bits, whatever the input: so it may always be broadcast. Of more hashes
#: than half of its bits it could no longer tell enough, and none is made.
WORD_BITS = 20
MOST_MEMBERS = 1 << (WORD_BITS + 5)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What Python workers call when a task ends, to give memory back.
at_end: list[Callable[[], None]] = []

#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE, LEAN_SLICE = 2000, 500


def give_back() -> None:
    """Free memory goes back to the system. Workers live on between tasks, beside an executor's other processes; without
    this each keeps the most that it ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def over_arrow(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], lean: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow: it gets batches of at most 2,000 rows, and when it ends memory is given back. With `lean` it gets
    at most 500 rows, and memory is given back after each of Spark's batches: some time for some memory."""
    size = LEAN_SLICE if lean else SLICE

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, size):
                yield b.slice(a, size)
            if lean:
                del b
                give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(sliced(batches))
        finally:
            for forgets in at_end:
                forgets()
            give_back()

    return run


_kept: list[tuple[object, object]] = []


def kept(key: object, make: Callable[[], T]) -> T:
    """What `make` gives, kept in a Python worker for its next tasks: one thing at a time, so that what one operator has
    built makes room for the next one's."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]  # type: ignore[return-value]


def utf8(text: str | Column) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_blocks(raw: bytes, keep: int = 0, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, white space being \\x20 and \\x09-\\x0D, in lists of about `size` bytes.

    Each list but the first begins with the last `keep` words before it, so that no shingle of keep + 1 words is lost
    and none comes twice; memory stays bounded for any length of text.
    """
    raw = raw.lower()  # of bytes: only A-Z
    if len(raw) <= size:
        yield raw.split()
        return
    at, tail = 0, []
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        words = tail + raw[at:end].split()
        at = end
        if len(words) <= keep and at < len(raw):
            tail = words
            continue
        yield words
        tail = words[len(words) - keep :] if keep else []


def fold_case(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << (WORD_BITS + 6)) - 1))


def membership(hashes: DataFrame, h: str) -> DataFrame | None:
    """A table (slot, bits) of at most 2**20 rows that tells of any hash whether it surely isn't among `hashes`; None if
    these are too many. hashes is read twice: it should be stored, or cheap."""
    if hashes.count() > MOST_MEMBERS:
        return None
    at = _slot(F.col(h))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftright(at, 6).alias("_slot")).agg(F.bit_or(bit).alias("_bits"))


def with_suspects(df: DataFrame, members: DataFrame | None, h: Column, name: str = "_suspect") -> DataFrame:
    """df with a boolean column: false where the row's hash surely isn't a member (null hashes aren't). The broadcast side
    is bounded by construction. df is the operator's own: its columns are not named as those that are added here."""
    if members is None:
        return df.withColumn(name, h.isNotNull())
    df = df.withColumn("_h", h)
    at = _slot(F.col("_h"))
    held = F.coalesce(F.call_function("shiftright", F.col("_bits"), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    m = members.select(F.col("_slot").alias("_at"), "_bits")
    return df.withColumn("_at", F.shiftright(at, 6)).join(F.broadcast(m), "_at", "left").withColumn(name, held).drop("_h", "_at", "_bits")


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one: beside it, an operator's own columns clash with none of them, however they are named."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def without(df: DataFrame, drops: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of df whose keys aren't in drops (stored; columns named as in keys). By the first key, rows that surely aren't
    meant are told and never shuffled, unless drops are too many to tell; further keys are worked out for others only."""
    first = next(iter(keys))
    members = membership(drops.select(F.xxhash64(first).alias("m")), "m")
    told = with_suspects(df.select(whole_row(df).alias("_row"), keys[first].alias("_first")), members, F.xxhash64("_first"))
    names = [f"_k{i}" for i in range(len(keys))]
    rest = told.filter("_suspect").select("_row.*")
    rest = rest.select(whole_row(df).alias("_row"), *(c.alias(n) for n, c in zip(names, keys.values(), strict=True)))
    gone = drops.select(*(F.col(k).alias(f"_gone{n}") for n, k in zip(names, keys, strict=True)))
    rest = rest.join(gone, [rest[n].eqNullSafe(gone[f"_gone{n}"]) for n in names], "left_anti")
    return told.filter("not _suspect").select("_row.*").unionByName(rest.select("_row.*"))


def join_groups(rows: DataFrame, groups: DataFrame, same: Callable[[DataFrame, DataFrame], Column], size: str) -> DataFrame:
    """rows, left-joined with the line of their group; `size` is the column of groups that counts a group's rows.

    A group of more than a thousandth of all rows would be one key of one task. Of such there are less than 1,000: these
    lines are broadcast, and their rows stay where they are. Only the rest is shuffled. groups is read three times and
    should be stored; its columns are named apart from those of rows.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * 1000 > total).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), same(rows, hot), "left")
    rest = met.filter("_hot is null").select(*rows.columns)
    return met.filter("_hot").drop("_hot").unionByName(rest.join(groups, same(rest, groups), "left"))
