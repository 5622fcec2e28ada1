"""Pages as recognisers read them: lines and words with boxes, merged, and what of them is to be covered."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions.ids import AADHAAR_RE, verhoeff_valid_np
from papertrail.functions.text import fold_digits_np, useful_chars

# A reading with fewer letters and digits isn't one; a line below this confidence is doubtful; boxes that
# share more than this of the smaller one's area hold the same line, words that share this of the lower one's height a row.
LEAST_CHARS, DOUBTFUL, SAME_LINE, SAME_ROW = 40, 0.5, 0.5, 0.5
# How far a cover reaches beyond a word, in shares of its height. Of twelve digits the first eight are covered.
PAD_X, PAD_Y = 0.15, 0.2
BOX = ["left", "top", "right", "bottom"]
#: Height of the bands of a page in which boxes meet.
BAND = 64.0
#: So many pages are read at once in a task.
PAGES = 1024


def _in_bands(lines: DataFrame) -> DataFrame:
    bands = F.sequence(F.floor(F.least("top", "bottom") / BAND), F.floor(F.greatest("top", "bottom") / BAND))
    return lines.withColumn("band", F.explode(bands))


def overlapping(a: DataFrame, b: DataFrame, least: float = SAME_LINE) -> DataFrame:
    """(page_id, a, b): numbers (line) of boxes of the same page that share more than `least` of the smaller one's area.

    Boxes meet in the bands of the page that both reach into; what two boxes share is measured once for each band.
    """
    left = _in_bands(a.select("page_id", F.col("line").alias("a"), *BOX)).select("page_id", "band", "a", *(F.col(c).alias(f"a_{c}") for c in BOX))
    right = _in_bands(b.select("page_id", F.col("line").alias("b"), *BOX)).select("page_id", "band", "b", *(F.col(c).alias(f"b_{c}") for c in BOX))
    wide = F.least("a_right", "b_right") - F.greatest("a_left", "b_left")
    high = F.least("a_bottom", "b_bottom") - F.greatest("a_top", "b_top")
    area = lambda x: (F.col(f"{x}_right") - F.col(f"{x}_left")) * (F.col(f"{x}_bottom") - F.col(f"{x}_top"))
    share = wide * high / F.greatest(F.least(area("a"), area("b")), F.lit(1.0))
    return left.join(right, ["page_id", "band"]).filter((wide > 0) & (high > 0) & (share > least)).select("page_id", "a", "b").distinct()


def merged_lines(first: DataFrame, other: DataFrame, *, script: str = "Devanagari") -> DataFrame:
    """Lines (page_id, line, text, confidence, left, top, right, bottom) of two recognisers as one page's, with `recogniser`
    and `place`: the other's lines in its script take the place of the first one's that stand in the same box; all in
    reading order (top, then left)."""
    own = other.filter(F.col("text").rlike(rf"\p{{Is{script}}}"))
    gone = overlapping(first, own).select("page_id", F.col("a").alias("line"))
    both = first.join(gone, ["page_id", "line"], "left_anti").withColumn("recogniser", F.lit("first")).unionByName(own.withColumn("recogniser", F.lit("other")))
    order = Window.partitionBy("page_id").orderBy("top", "left", "recogniser", "line")
    return both.withColumn("place", F.row_number().over(order))


def readings(first: DataFrame, other: DataFrame, fallback: DataFrame, *, script: str = "Devanagari") -> DataFrame:
    """(page_id, engine, useful, doubtful, text): the reading of each page.

    Two recognisers' lines are merged (engine merged). If they give fewer than 40 letters and digits, or more than half of
    their lines are doubtful, the fallback's lines count instead, provided that they have more letters and digits; the
    engine is fallback then, or merged+fallback if the others had read something. A page holds a bounded number of lines.
    """

    def read(lines: DataFrame, name: str) -> DataFrame:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
        doubtful = F.sum((F.col("confidence") < DOUBTFUL).cast("int")) * 2 > F.count("*")
        page = lines.groupBy("page_id").agg(text.alias(f"{name}_text"), doubtful.alias(f"{name}_doubtful"))
        return page.withColumn(f"{name}_useful", useful_chars(F.col(f"{name}_text")))

    order = Window.partitionBy("page_id").orderBy("top", "left", "line")
    pages = read(merged_lines(first, other, script=script), "m").join(read(fallback.withColumn("place", F.row_number().over(order)), "f"), "page_id", "full")
    useful, doubtful = F.coalesce("m_useful", F.lit(0)), F.coalesce("m_doubtful", F.lit(False))
    takes = ((useful < LEAST_CHARS) | doubtful) & (F.coalesce("f_useful", F.lit(0)) > useful)
    engine = F.when(~takes, "merged").when(useful == 0, "fallback").otherwise("merged+fallback")
    return pages.select("page_id", engine.alias("engine"), F.when(takes, F.col("f_useful")).otherwise(useful).alias("useful"), doubtful.alias("doubtful"), F.when(takes, F.col("f_text")).otherwise(F.coalesce("m_text", F.lit(""))).alias("text"))


def _rows_of(page: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Rows of words that are sorted by page and from the top: a word belongs to the first row whose first word it shares half
    the lower one's height with, else it begins a row. Each round takes a row off every page: its first word that is left,
    and what meets it."""
    row, left, high, at = np.zeros(len(page), np.int32), np.arange(len(page)), bottom - top, 0
    while len(left):
        begins = np.flatnonzero(np.diff(page[left], prepend=-1))
        head = np.repeat(left[begins], np.diff(begins, append=len(left)))
        shared = np.minimum(bottom[head], bottom[left]) - np.maximum(top[head], top[left])
        lower = np.maximum(np.minimum(high[head], high[left]), 1e-6)
        met, at = (head == left) | ((shared > 0) & (shared / lower >= SAME_ROW)), at + 1
        row[left[met]] = at
        left = left[~met]
    return row


class _Numbers(NamedTuple):
    """Valid twelve-digit numbers in lines of words: where in its line each begins, its digits, and for its first two
    groups of four the word that holds them and their place in it."""

    start: np.ndarray
    digits: np.ndarray
    word: np.ndarray
    at: np.ndarray


def _numbers(line: np.ndarray, text: pa.Array) -> _Numbers:
    """Those that words spell when each line's (line: ascending) are joined by blanks. A group of four stands in one word."""
    borders = np.r_[np.flatnonzero(np.diff(line, prepend=-1)), len(line)]
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), text), " ")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py() or ""
    spelt = fold_digits_np(np.frombuffer(whole.encode("utf-32-le"), "<u4"))
    whole = whole if whole.isascii() else spelt.tobytes().decode("utf-32-le")
    begins = np.cumsum(np.r_[0, pc.utf8_length(text).to_numpy() + 1])[:-1]
    groups = np.array([(m.start(1), m.start(2), m.start(3)) for m in AADHAAR_RE.finditer(whole)], np.int64).reshape(-1, 3)
    digits = (spelt[(groups[:, :, None] + np.arange(4)).reshape(-1, 12)] - ord("0")).astype(np.int64)
    ok = verhoeff_valid_np(digits)
    groups, digits = groups[ok], digits[ok]
    word = np.searchsorted(begins, groups[:, :2], "right") - 1
    first = begins[borders[:-1]][np.searchsorted(borders, word[:, 0], "right") - 1]
    return _Numbers(groups[:, 0] - first, digits, word, groups[:, :2] - begins[word])


class _Pages(NamedTuple):
    """Pages of a batch: their words (with the page's place in the batch), the rows of those with boxes in a row's order
    (placed: their numbers), the numbers in rows."""

    page: np.ndarray
    word: pa.Array
    text: pa.Array
    rank: np.ndarray
    box: np.ndarray
    placed: np.ndarray
    row: np.ndarray
    found: _Numbers


def _read(b: pa.RecordBatch) -> _Pages:
    word, text, *sides = b.column("words").flatten().flatten()
    page = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("words")).to_numpy())
    rank = pc.rank(word, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    box = np.array([pc.fill_null(x, 0.0).to_numpy() for x in sides])
    boxed = np.flatnonzero(np.all([x.is_valid().to_numpy(zero_copy_only=False) for x in sides], axis=0))
    left, top, right, bottom = box[:, boxed]
    boxed = boxed[np.lexsort((right, left, bottom, rank[boxed], top, page[boxed]))]
    row = _rows_of(page[boxed], box[1, boxed], box[3, boxed])
    spelt = text.is_valid().to_numpy(zero_copy_only=False)[boxed]
    boxed, row = boxed[spelt], row[spelt]
    order = np.lexsort((rank[boxed], box[0, boxed], row, page[boxed]))
    placed, row = boxed[order], row[order]
    line = np.cumsum((np.diff(page[placed], prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    return _Pages(page, word, text, rank, box, placed, row, _numbers(line, text.take(pa.array(placed))))


def _by_page(words: DataFrame) -> DataFrame:
    each = F.struct("word", "text", *(F.col(c).cast("double").alias(c) for c in BOX))
    return words.groupBy("page_id").agg(F.collect_list(each).alias("words"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES))


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        p = _read(b)
        n = p.found
        # one cover where both groups stand in one word, else one for each
        same = n.word[:, 0] == n.word[:, 1]
        begins, ends = n.at, np.column_stack([np.where(same, n.at[:, 1], n.at[:, 0]), n.at[:, 1]]) + 4
        which, group = np.nonzero(np.column_stack([np.ones(len(same), bool), ~same]))
        at = p.placed[n.word[which, group]]
        left, top, right, bottom = p.box[:, at]
        wide, high, size = right - left, bottom - top, np.maximum(pc.utf8_length(p.text.take(pa.array(at))).to_numpy(), 1)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("page_id").take(pa.array(p.page[at])),
                pa.array(p.row[n.word[which, group]]),
                pa.array(n.start[which].astype(np.int32)),
                pa.array(["".join(map(str, d)) for d in n.digits[which].tolist()], pa.string()),
                p.word.take(pa.array(at)),
                pa.array(left + wide * begins[which, group] / size - high * PAD_X),
                pa.array(top - high * PAD_Y),
                pa.array(left + wide * ends[which, group] / size + high * PAD_X),
                pa.array(bottom + high * PAD_Y),
            ],
            names=["page_id", "row", "start", "digits", "word", *BOX],
        )


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        p = _read(b)
        drawn = p.placed[p.found.word]
        boxed = np.bincount(p.page[drawn[:, 0]], minlength=b.num_rows)
        covered = np.zeros(len(p.page), bool)
        covered[drawn] = True
        order = np.lexsort((p.rank, p.page))
        order = order[p.text.is_valid().to_numpy(zero_copy_only=False)[order]]
        read = order[_numbers(p.page[order], p.text.take(pa.array(order))).word]
        missed = np.bincount(p.page[read[~covered[read].all(axis=1), 0]], minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(boxed + missed), pa.array(boxed), pa.array(missed == 0)], names=["page_id", "found", "boxed", "complete"])


def covers(words: DataFrame) -> DataFrame:
    """(page_id, row, start, digits, word, left, top, right, bottom): boxes that cover the first eight digits of each valid
    twelve-digit number that stands in a row of words, however it is split among them; the last four stay readable.

    A row is its words from the left, one blank between them; words without a box are in no row. A word is covered from its
    first such digit to its last, in proportion to its characters, and a little beyond. A page holds a bounded number of
    words: Spark gathers them, and pages are read a batch at a time.
    """
    kinds = {c: words.schema[c].dataType.simpleString() for c in ("page_id", "word")}
    return _by_page(words).mapInArrow(_covers, f"page_id {kinds['page_id']}, row int, start int, digits string, word {kinds['word']}, " + ", ".join(f"{c} double" for c in BOX))


def mask_plans(words: DataFrame) -> DataFrame:
    """(page_id, found, boxed, complete) for every page that has words: may it be shared once the covers are drawn?

    Numbers are read in the rows of words with boxes, and in the page's words in reading order (word), boxes or not. One
    that is read in words of which not all are covered has no box: the plan is not complete, and fails closed. Both readings
    are of the same words of a page, which are gathered once.
    """
    return _by_page(words).mapInArrow(_plans, f"page_id {words.schema['page_id'].dataType.simpleString()}, found long, boxed long, complete boolean")
