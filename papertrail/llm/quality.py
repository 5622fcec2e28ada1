"""Quality scores by a factorisation machine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow, utf8

#: The labelled sample: so many documents at most (the smallest by a hash of their id), and so many entries of their feature
#: vectors together at most. Their texts are read whole.
SAMPLE_DOCS, SAMPLE_ENTRIES = 20_000, 8_000_000
#: Words are hashed into so many features; each statistic has so many levels, each a feature of its own.
WORDS, LEVELS = 1 << 16, 32
#: The model: factors of each feature; documents of a step, least rounds over the sample and least steps of them all, rate of
#: learning, weight of the norms.
RANK, BATCH, EPOCHS, STEPS, RATE, DECAY = 8, 64, 4, 1500, 0.1, 1e-5

CLASSES = [bytes(range(ord("A"), ord("Z") + 1)), b"0123456789", b".,;:!?", b"#$%&*|", b"()[]{}<>\"'/\\=+-_~^@`", b" \t\n\x0b\x0c\r", bytes(range(128, 256))]
STATISTICS = 12 + len(CLASSES)


def log_level(n: float) -> int:
    return min(LEVELS - 1, int(2 * np.log2(n + 1)) if n < 1 << 16 else LEVELS - 1)


def share_level(part: float, whole: float) -> int:
    return min(LEVELS - 1, int(LEVELS * part / whole)) if whole else 0


def small_level(part: float, whole: float) -> int:
    """Levels of a share that is rarely large: one for each power of the square root of two below 1."""
    return 0 if not part else max(1, min(LEVELS - 1, int(LEVELS - 1 + 2 * np.log2(part / whole))))


def statistics(text: bytes, code_points: int, words: list[bytes], counts: Counter) -> list[int]:
    """The levels of a whole text's structure."""
    size, n = len(text), len(words)
    lines = text.split(b"\n")
    longest = max(map(len, words), default=0)
    repeats = sum(map(eq, words, words[1:]))
    once = sum(1 for c in counts.values() if c == 1)
    own = [
        log_level(size),
        log_level(n),
        log_level(len(lines)),
        share_level(len(counts), n),
        share_level(once, n),
        share_level(len(set(lines)), len(lines)),
        small_level(max(counts.values(), default=0), n),
        small_level(repeats, n),
        log_level(longest),
        min(LEVELS - 1, int(2 * code_points / n)) if n else 0,
        small_level(sum(1 for x in lines if not x or x.isspace()), len(lines)),
        small_level(size - code_points, size),
    ]
    return own + [small_level(size - len(text.translate(None, c)), size) for c in CLASSES]


def features(text: bytes, code_points: int, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: words (A-Z lower-cased, hashed; together of length 1), levels of the structure, levels of
    the metadata, and whether a number that should count the characters does."""
    words = text.split()
    counts = Counter(words)
    hashed = np.fromiter(map(crc32, {w.lower() for w in counts}), "u4") % WORDS
    levels = statistics(text, code_points, words, counts)
    for m in metadata:
        known = m is not None and m == m
        levels += [log_level(max(0.0, m)) if known else LEVELS - 1, 2 if not known else int(m == code_points)]
    flat = WORDS + LEVELS * np.arange(len(levels)) + np.array(levels)
    values = np.ones(len(hashed) + len(flat), "f4")
    values[: len(hashed)] = 1 / np.sqrt(max(1, len(hashed)))
    values[len(hashed) :] = 0.25
    return np.concatenate([hashed, flat]).astype("i4"), values


class Machine(NamedTuple):
    """score = bias + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows that lie one behind the other and begin at `starts`, in time linear in their entries: the pairs of a
        row add up to half of (sum v_i x_i)^2 - sum (v_i x_i)^2."""
        vx = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, seed: int = 1) -> Machine:
    """Logistic loss, adaptive steps by feature, in an order that only the seed decides. Without rows of both labels the
    machine is their smoothed share."""
    good = float(labels.sum())
    bias = float(np.log((good + 1) / (len(labels) - good + 1)))
    random = np.random.default_rng(seed)
    w, v = np.zeros(size, "f4"), random.normal(0, 0.05, (size, RANK)).astype("f4")
    if not 0 < good < len(labels):
        return Machine(bias, w, 0 * v)
    seen_w, seen_v = np.full(size, 1e-3, "f4"), np.full((size, RANK), 1e-3, "f4")
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(rows) // BATCH)))):
        order = random.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            index, value = (np.concatenate([rows[r][k] for r in batch]) for k in range(2))
            lengths = np.array([len(rows[r][0]) for r in batch])
            starts, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(batch)), lengths)
            error = (sigmoid(Machine(bias, w, v).raw(index, value, starts)) - labels[batch]) / len(batch)
            bias -= RATE * float(error.sum())
            vx = v[index] * value[:, None]
            pull = (error[of] * value)[:, None] * (np.add.reduceat(vx, starts)[of] - vx)
            held, place = np.unique(index, return_inverse=True)
            step_w = np.bincount(place, error[of] * value, len(held)) + DECAY * w[held]
            step_v = np.stack([np.bincount(place, pull[:, f], len(held)) for f in range(RANK)], axis=1) + DECAY * v[held]
            seen_w[held] += step_w**2
            seen_v[held] += step_v**2
            w[held] -= RATE * step_w / np.sqrt(seen_w[held])
            v[held] -= RATE * step_v / np.sqrt(seen_v[held])
    return Machine(bias, w, v)


def _read(docs: DataFrame, extra: dict[str, Column], text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    number = [F.col(f"`{m}`").cast("double") for m in metadata if m in docs.columns]
    return docs.select(*(c.alias(k) for k, c in extra.items()), utf8(text_col).alias("text"), F.array(*number).cast("array<double>").alias("metadata"))


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = pc.utf8_length(b.column("text").cast(pa.string())).to_pylist()
    return (features(t, n, m) for t, n, m in zip(b.column("text").to_pylist(), points, b.column("metadata").to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",)) -> Machine:
    """The machine of the labelled sample: at most 20,000 of labels' rows, and of these as many documents, in the order of
    a hash of their id, as have 8 million entries. An id that labels repeat counts with its largest label; null labels and
    ids teach nothing. Only the sample's feature vectors come to the driver, where the machine is trained.
    """
    size = WORDS + LEVELS * (STATISTICS + 2 * sum(m in docs.columns for m in metadata))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter("id is not null and y is not null")
    drawn = known.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(SAMPLE_DOCS)
    rows = _read(docs, {"id": F.col(id_col)}, text_col, metadata).join(F.broadcast(drawn), "id").select("turn", "y", "text", "metadata")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, value = zip(*_vectors(b), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.float64()), pa.array([x.tobytes() for x in index], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())], names=["turn", "y", "index", "value"])

    found = rows.mapInArrow(over_arrow(read, lean=True), "turn long, y double, index binary, value binary")
    taken, y, entries = [], [], 0
    for r in found.orderBy("turn", "index").toLocalIterator():
        entries += len(r["index"]) // 4
        if entries > SAMPLE_ENTRIES:
            break
        taken.append((np.frombuffer(r["index"], "i4"), np.frombuffer(r["value"], "f4")))
        y.append(float(r["y"] > 0))
    return train(taken, np.array(y), size)


def score(docs: DataFrame, machine: Machine, *, extra: dict[str, Column], text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), threshold: float = 0.3) -> DataFrame:
    """One row for every row of docs: the columns named in extra, score (0 to 1, higher: a positive label is likelier) and
    predicted (1 from the threshold on).

    Scores come from the whole text and the metadata columns (numbers; null, or a column that isn't there, is a level of
    its own). Null texts count as empty, which is a text as any other. Repeated rows are scored each. No shuffle; a task
    holds one batch. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = _read(docs, {f"_{k}": c for k, c in enumerate(extra.values())}, text_col, metadata)
    own = list(extra)
    kinds = ", ".join(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(own, rows.schema, strict=False))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = list(_vectors(b))
            lengths = np.array([len(x) for x, _ in vectors], int)
            out = np.zeros(0)
            if vectors:
                out = sigmoid(shared.value.raw(np.concatenate([x for x, _ in vectors]), np.concatenate([v for _, v in vectors]), np.cumsum(lengths) - lengths).astype("f8"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(own))), pa.array(out), pa.array((out >= threshold).astype("i4"))], names=[*own, "score", "predicted"])

    return rows.mapInArrow(over_arrow(scored, lean=True), f"{kinds}, score double, predicted int")
