"""What each of five filters removes, in every order in which they can be applied."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import join_groups, over_arrow, stored, utf8

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: bytes, code_points: int) -> int:
    """The bits of the filters A to D that a text fails; words are cut at \\x20 and \\x09-\\x0D."""
    words = text.split()  # of bytes: at just these
    n = len(words)
    found = n < 200
    found |= (100 * len(set(words)) < 50 * n) << 1
    found |= (100 * (len(text) - len(text.translate(None, CAPITALS))) > 3 * code_points) << 2
    return found | (SIGNS.search(text) is not None) << 3


def flagged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for every row of docs: id, part, and the booleans A to E (stored files: what is read twice).

    Each text is read once, whole, and leaves as four bits, its length and its SHA-256; texts are never shuffled. E holds
    where a row of the same digest and length has a smaller id: digests are grouped (with map-side combine), and rows find
    their group by join_groups(), so that a text which a third of all rows share stays where it is. Null texts are empty,
    null parts the empty string. A null id is neither smaller nor larger than another: such a row doesn't fail E.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2)
            points = pc.utf8_length(raw.cast(pa.string())).to_pylist()
            texts = raw.to_pylist()
            bits = [failures(t, n) for t, n in zip(texts, points, strict=True)]
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "n_bytes", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), utf8(text_col).alias("text"))
    rows = stored(rows.mapInArrow(over_arrow(read), f"id {kind}, part string, bits int, n_bytes long, digest binary"), "flags")
    groups = rows.groupBy("n_bytes", "digest").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    groups = stored(groups.select(F.col("n_bytes").alias("n"), F.col("digest").alias("d"), "first", "size"), "alike")
    met = join_groups(rows, groups, lambda r, g: (r["digest"] == g["d"]) & (r["n_bytes"] == g["n"]), "size")
    bit = lambda k: F.col("bits").bitwiseAND(F.lit(1 << k)) != 0
    return met.select("id", "part", *(bit(k).alias(f) for k, f in enumerate(FILTERS[:-1])), F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


def _selected(alias: str = "g") -> Column:
    """Which filters a grouping set of the cube has, as bits: grouping_id() counts those that it lacks, the last one lowest."""
    return sum((F.shiftleft(1 - F.grouping(f).cast("int"), k) for k, f in enumerate(FILTERS)), F.lit(0)).alias(alias)


def survivors(flags: DataFrame, labels: DataFrame, *, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) for each part and each of the 32 subsets of the filters: how many rows fail none of
    them, and how many of these have quality = 1 or toxic = 1 in labels.

    Rows are first counted by part and flags, at most 32 lines a part, so that the cube works on counts. Its grouping
    sets which hold the part give each subset; of their lines those whose selected flags are all false are the survivors.
    An id that labels repeat counts once, with its largest quality and toxic; null ids have no label.
    """
    marks = labels.groupBy(F.col(label_id).alias("m")).agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t"))
    marks = marks.filter("q or t")
    keys = ["part", *FILTERS]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = flags.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({"good": zero, "toxic": zero})
    known = flags.join(marks, flags["id"] == marks["m"]).select(*keys, zero.alias("n"), F.when(F.col("q"), one).otherwise(zero).alias("good"), F.when(F.col("t"), one).otherwise(zero).alias("toxic"))
    known = known.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    lines = stored(counted.unionByName(known), "counts")
    cube = lines.cube(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), _selected(), F.grouping("part").alias("any_part"))
    clean = ~F.coalesce(F.greatest(*(F.col(f) for f in FILTERS)), F.lit(False))  # a flag that isn't selected is null
    left = cube.filter((F.col("any_part") == 0) & clean).select("part", F.col("g").alias("mask"), "n", "good", "toxic")
    grid = lines.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    return grid.join(left, ["part", "mask"], "left").na.fill(0, ["n", "good", "toxic"])


def interactions(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included: part, filter_order, step, filter, and the
    counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (long).

    Failure conditions of whole texts: A under 200 words; B less than half of the words distinct; C over 3 % of the code
    points in A-Z; D any of #$%&*|; E identical to a text with a smaller id anywhere in the table. A step leads from the
    survivors of the filters before it to those with its own; both are lines of survivors(), met by their subset. So the
    work beyond one pass over the texts doesn't grow with rows, whatever part or text holds a third of them.

    Nulls, empty texts, repeated rows, repeated labels: see flagged() and survivors(). Only the id, text and part of docs
    are read, whatever other columns are named. An empty table has no parts and gives no rows.
    """
    sets = stored(survivors(flagged(docs, id_col=id_col, text_col=text_col, part_col=part_col), labels, label_id="doc_id"), "survivors")
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append((order, k, f, before, after := before | 1 << FILTERS.index(f)))
            before = after
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")  # 600 rows, always

    def of(prefix: str) -> DataFrame:
        return sets.select(F.col("part").alias(f"{prefix}_part"), F.col("mask").alias(f"{prefix}_mask"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("n", "good", "toxic")))

    at = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("n")))
    each = [F.struct(F.lit(f).alias("f"), (at(0) - at(1 << k)).alias("fails"), (at(ALL ^ (1 << k)) - at(ALL)).alias("unique_fails")) for k, f in enumerate(FILTERS)]
    filters = sets.groupBy(F.col("part").alias("p")).agg(F.array(*each).alias("each")).select("p", F.inline("each"))
    first = of("b").join(F.broadcast(steps), F.col("b_mask") == F.col("before"))
    pairs = first.join(of("a"), (F.col("a_part") == F.col("b_part")) & (F.col("a_mask") == F.col("after")))
    rows = pairs.join(filters, (F.col("b_part") == F.col("p")) & (F.col("filter") == F.col("f")))
    removed = F.col("b_n") - F.col("a_n")
    return rows.select(
        F.col("b_part").alias("part"),
        "filter_order",
        "step",
        "filter",
        F.col("a_n").alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        "unique_fails",
        (F.col("b_good") - F.col("a_good")).alias("good_lost"),
        (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("b_part", "filter")).alias("shapley"),
    )
