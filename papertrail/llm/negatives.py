"""Hard negatives by exact inner-product search over one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow, partitions, stored

#: Pivots are fitted on so many rows (the smallest by a hash of their id) at most, so many of them at most.
SAMPLE, PIVOTS, ROUNDS = 2048, 64, 8
#: A chunk, which one task searches, has so many rows at most, and so many components in all its rows together.
CHUNK_ROWS, CHUNK_VALUES, LEAST_ROWS = 1 << 17, 1 << 24, 256
#: Neighbours by key that are taken or left together; of these so many at once; so many anchors at once.
CELL, RING, PROBES = 1024, 16, 256
#: What components are cut to, so that they fit a long.
LARGEST = float(1 << 62)
NONE = -(1 << 63)


class Space(NamedTuple):
    """Vectors x become points (x, sqrt(radius2 - |x|^2)), all on one sphere; an anchor q becomes (q, 0). Then
    distance^2 = |q|^2 + radius2 - 2 qx: what is nearest has the largest inner product."""

    dim: int
    radius2: float
    kind: str  # how components are kept
    work: str  # in what type inner products are exact
    pivots: np.ndarray  # in the augmented space

    def slack(self) -> float:
        return 1e-6 * float(np.sqrt(self.radius2)) + 1e-9

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x.astype("f8")
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.radius2 - np.einsum("ij,ij->i", x, x)))[:, None]])

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of anchors from the pivots, and |q|^2."""
        x = x.astype("f8")
        return distances(np.hstack([x, np.zeros((len(x), 1))]), self.pivots), np.einsum("ij,ij->i", x, x)

    def bounds(self, x: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor and each interval of keys: the smallest distance there can be, the smallest and the largest score."""
        away, norm2 = self.probes(x)
        away, slack = away[:, pivot], self.slack()
        near = np.maximum(0.0, np.maximum(away - high, low - away) - slack)
        far = away + high + slack
        both = (norm2 + self.radius2)[:, None]
        margin = 1e-9 * both + 1e-6
        return near, (both - far * far) / 2 - margin, (both - near * near) / 2 + margin


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d2))


def components(lists: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each list, as doubles; shorter lists are filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    values = np.clip(values, -LARGEST, LARGEST)
    out = np.zeros((len(lists), dim))
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def fitted(sample: np.ndarray, space: Space) -> np.ndarray:
    """Pivots: a few rounds of k-means over the sample, begun with each row that is farthest from those chosen."""
    points = space.points(sample)
    k = max(1, min(PIVOTS, len(points) // 16))
    chosen, away = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < k and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
    pivots = points[chosen]
    for _ in range(ROUNDS):
        own = distances(points, pivots).argmin(axis=1)
        pivots = np.array([points[own == p].mean(axis=0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id, then row."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, tie = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        if len(tie) > 4 * k:  # many equal vectors
            tie = tie[ids[tie] <= np.partition(ids[tie], k)[k]]
        at = np.concatenate([above, tie])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:k]]


class Chunk:
    """Rows of one chunk, in the order of their keys (pivot, distance), in cells of neighbours."""

    def __init__(self, batches: list[pa.RecordBatch], space: Space) -> None:
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        self.space = space
        self.rows, self.ids, self.labels, pivot, distance = (column(c) for c in ("row", "id", "label", "pivot", "distance"))
        self.x = unpacked([v for b in batches for v in b.column("x").to_pylist()], space)
        cuts = np.flatnonzero(np.diff(pivot)) + 1
        self.begin = np.unique(np.concatenate([np.arange(0, len(pivot), CELL), cuts]))
        self.end = np.append(self.begin[1:], len(pivot))
        self.pivot, self.low, self.high = pivot[self.begin], distance[self.begin], distance[self.end - 1]

    def search(self, b: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
        """For each anchor and each of its slots the k best rows of this chunk between the slot's floor and cap.

        Cells are taken ring by ring, from the smallest distance outwards; those in which no anchor can find a score
        between its floors and caps are left out, and floors rise as better rows are found.
        """
        probe, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
        x = unpacked(b.column("x").to_pylist(), self.space)
        slots = max((len(v) for v in b.column("caps").to_pylist()), default=0)
        cap, floor = np.full((len(probe), slots), NONE), np.full((len(probe), slots), -NONE - 1)
        for a, (c, f) in enumerate(zip(b.column("caps").to_pylist(), b.column("floors").to_pylist(), strict=True)):
            cap[a, : len(c)], floor[a, : len(f)] = c, f
        if self.space.work != "i8":
            cap, floor = cap.astype("f8"), floor.astype("f8")
        near, least, most = self.space.bounds(x, self.pivot, self.low, self.high)
        order = near.min(axis=0).argsort(kind="stable")
        held: dict[tuple[int, int], np.ndarray] = {}  # scores, ids and rows that were found so far
        at, size = 0, 1
        while at < len(order):
            cells, at, size = order[at : at + size], at + size, min(RING, 2 * size)
            lowest, highest = floor.min(axis=1), cap.max(axis=1)
            open_ = (most[:, cells] >= lowest[:, None]) & (least[:, cells] <= highest[:, None])
            who, cells = np.flatnonzero(open_.any(axis=1)), cells[open_.any(axis=0)]
            if not len(who):
                continue
            here = np.concatenate([np.arange(self.begin[c], self.end[c]) for c in cells])
            scores = x[who] @ self.x[here].T
            fits = (scores >= lowest[who, None]) & (scores <= highest[who, None]) & ((label[who, None] == self.labels[here]) == same)
            found_a, found_x = np.nonzero(fits)
            borders = np.flatnonzero(np.diff(found_a)) + 1
            for own, xs in zip(np.split(found_a, borders), np.split(found_x, borders), strict=True):
                if not len(own):
                    continue
                a, s, rows = who[own[0]], scores[own[0], xs], here[xs]
                if same:
                    other = self.rows[rows] != probe[a]
                    s, rows = s[other], rows[other]
                s = s.astype("i8")
                for j in range(slots):
                    in_slot = (s >= floor[a, j]) & (s <= cap[a, j])
                    if in_slot.any():
                        new = np.array([s[in_slot], self.ids[rows[in_slot]], self.rows[rows[in_slot]]])
                        if (a, j) in held:
                            new = np.hstack([held[a, j], new])
                        new = new[:, best(new[0], new[1], new[2], k)]
                        held[a, j] = new
                        if new.shape[1] == k:
                            floor[a, j] = max(floor[a, j], new[0, -1])
        keys, lists = list(held), list(held.values())
        flat = np.hstack(lists) if lists else np.zeros((3, 0), "i8")
        n = np.array([v.shape[1] for v in lists], "i8")
        long = lambda v: pa.array(np.asarray(v, "i8"))
        return pa.RecordBatch.from_arrays([long(np.repeat(np.array([probe[a] for a, _ in keys], "i8"), n)), pa.array(np.repeat(np.array([j for _, j in keys], "i4"), n)), long(flat[0]), long(flat[1]), long(flat[2])], names=["probe", "slot", "score", "id", "row"])


def unpacked(values: list[bytes], space: Space) -> np.ndarray:
    return np.frombuffer(b"".join(values), space.kind).reshape(len(values), space.dim).astype(space.work)


class Index(NamedTuple):
    """rows (stored): chunk, row, id, label, anchor, pivot, distance, x, each chunk a run of keys; intervals: what keys chunks hold."""

    rows: DataFrame
    space: Space
    chunks: np.ndarray
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray


def index(vectors: DataFrame, scale: float = 256.0) -> Index | None:
    """The index of vectors (id long, label long, anchor boolean, v array of finite numbers); None of an empty table.

    Every row is indexed; only pivots are fitted on a sample. Each row's key is its nearest pivot and its distance from
    it; rows are stored sorted by key, in chunks of equal size however many rows share a pivot, a distance or a vector.
    Through the driver go the sample and each chunk's intervals of keys, one line or two for up to 131,072 rows.
    """
    spark = vectors.sparkSession

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(0)
                dim = int(np.diff(lists.offsets.to_numpy()).max())
                x = components(lists, dim, scale)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([dim], pa.int32()), pa.array([float(np.einsum("ij,ij->i", x, x).max())]), pa.array([float(np.abs(x).max(initial=0))])], names=["n", "dim", "norm2", "large"])

    doubles = F.transform("v", lambda x: x.cast("double"))
    stats = vectors.select(doubles.alias("v")).mapInArrow(over_arrow(measured), "n long, dim int, norm2 double, large double").agg(F.sum("n"), F.max("dim"), F.max("norm2"), F.max("large")).first()
    if not stats[0]:
        return None
    n, dim, radius2, large = stats
    kind = "<i2" if large < 1 << 15 else "<f8" if large < 1 << 53 else "<i8"
    work = "f4" if radius2 < 1 << 24 else "f8" if radius2 < 1 << 53 else "i8"
    dim = max(1, dim)
    drawn = vectors.select("id", doubles.alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    bare = Space(dim, radius2, kind, work, np.zeros((0, dim + 1)))
    space = bare._replace(pivots=fitted(components(drawn.chunk(0) if isinstance(drawn, pa.ChunkedArray) else drawn, dim, scale), bare))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = components(b.column(3), dim, scale)
            away = distances(space.points(x), space.pivots)
            pivot = away.argmin(axis=1)
            packed = [r.tobytes() for r in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pivot.astype("i4")), pa.array(away[np.arange(len(x)), pivot]), pa.array(packed, pa.binary())], names=["id", "label", "anchor", "pivot", "distance", "x"])

    spread = partitions(spark)
    size = int(min(CHUNK_ROWS, max(LEAST_ROWS, n // (4 * spread)), max(1, CHUNK_VALUES // dim)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((task << 24) + place // size), pa.array((task << 40) + place), *b.columns], names=["chunk", "row", *b.schema.names])

    key = ["pivot", "distance", "id"]
    rows = vectors.select("id", "label", "anchor", doubles.alias("v")).mapInArrow(over_arrow(keyed), "id long, label long, anchor boolean, pivot int, distance double, x binary")
    ranged = rows.repartitionByRange(max(spread, -(-n // CHUNK_ROWS)), *key).sortWithinPartitions(*key)
    rows = stored(ranged.mapInArrow(over_arrow(numbered), "chunk long, row long, id long, label long, anchor boolean, pivot int, distance double, x binary"), "keys")
    held = rows.groupBy("chunk", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).toPandas()
    return Index(rows, space, *(held[c].to_numpy() for c in ("chunk", "pivot", "low", "high")))


def _scan(index: Index, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each visited chunk for each slot: probe, slot, score, id, row.

    visits: chunk, row, label, x, caps, floors. A chunk's rows and then its visitors come to one task in order: it holds
    one chunk and streams the visitors. Anchors are copied to chunks, never rows of the index to anchors.
    """
    space = index.space

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, ready = None, [], None
        for b in batches:
            turn = 2 * b.column("chunk").to_numpy() + b.column("kind").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), b.num_rows]
            for begin, end in zip(borders, borders[1:]):
                if begin == end:
                    continue
                if turn[begin] % 2 == 0:
                    if turn[begin] != chunk:
                        chunk, parts, ready = turn[begin], [], None
                    parts.append(b.slice(begin, end - begin))
                    continue
                if ready is None:
                    ready, parts = Chunk(parts, space), []
                for a in range(begin, end, PROBES):
                    yield ready.search(b.slice(a, min(PROBES, end - a)), k, same)

    nothing = F.lit(None)
    mine = index.rows.select("chunk", F.lit(0).alias("kind"), "row", "id", "label", "pivot", "distance", "x", nothing.cast("array<bigint>").alias("caps"), nothing.cast("array<bigint>").alias("floors"))
    theirs = visits.select("chunk", F.lit(1).alias("kind"), "row", nothing.cast("long").alias("id"), "label", nothing.cast("int").alias("pivot"), nothing.cast("double").alias("distance"), "x", "caps", "floors")
    both = mine.unionByName(theirs).repartition(partitions(index.rows.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "pivot", "distance", "row")
    return both.mapInArrow(over_arrow(searched), "probe long, slot int, score long, id long, row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("probe", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, probes: DataFrame, k: int, *, same: bool) -> DataFrame:
    """For each probe and slot the first k rows by score, ties by id, among those of the same label (other rows than the
    probe itself) or of a different label: probe, slot, score, id, row, rank. Exact.

    probes: chunk, row, label, x, and for each slot a cap and a floor for its scores (arrays caps, floors; null floors
    exclude nothing). First each probe searches the chunk that holds its own key. The k-th score found there bounds the
    distance of anything better: in the second round it visits the chunks whose key intervals reach into the annulus
    between that distance and its cap, which is what certifies the result.
    """
    first = stored(_best(_scan(index, probes, k, same), k), "near")
    risen = first.filter(F.col("rank") == k).groupBy("probe").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # a probe has few slots
    met = probes.join(risen, probes["row"] == risen["probe"], "left")
    met = met.withColumn("floors", F.transform("floors", lambda f, j: F.coalesce(F.greatest(f, F.col("kth")[j]), f)))
    space, chunks, pivots, low, high = index[1:]
    names = np.unique(chunks)
    place = np.searchsorted(names, chunks)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, PROBES):
                b = whole.slice(a, PROBES)
                _, least, most = space.bounds(unpacked(b.column("x").to_pylist(), space), pivots, low, high)
                floors = np.array([min(f, default=-NONE - 1) for f in b.column("floors").to_pylist()], "f8")
                caps = np.array([max(c, default=NONE) for c in b.column("caps").to_pylist()], "f8")
                reach = np.zeros((b.num_rows, len(names)), bool)
                who, which = np.nonzero((most >= floors[:, None]) & (least <= caps[:, None]))
                reach[who, place[which]] = True
                reach[np.arange(b.num_rows), np.searchsorted(names, b.column("chunk").to_numpy())] = False  # that one was the first
                who, which = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array(names[which]), *(b.column(c).take(pa.array(who)) for c in ("row", "label", "x", "caps", "floors"))], names=["chunk", "row", "label", "x", "caps", "floors"])

    more = met.select("chunk", "row", "label", "x", "caps", "floors").mapInArrow(over_arrow(visited), "chunk long, row long, label long, x binary, caps array<bigint>, floors array<bigint>")
    both = first.drop("rank").unionByName(_scan(index, more, k, same))
    return _best(both, k)


def hard_negatives(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of floor(scale * x). An anchor's positives are its first `positives` other rows
    of the same label by score, ties by smaller id. The first `negatives` rows of other labels whose score is between
    `low` and `high` percent of the positive's are returned for each; with a negative positive score that is none.
    anchor: which rows are anchors (all, if None). Both searches are exact (see search()).

    Rows with a null id, label, vector, or a null or non-finite component take no part. Vectors may differ in length:
    what one lacks counts as zero. Repeated rows are rows: each is found, and each anchors. Scores are exact as long as
    they fit a long; components are cut at 2**62. Other columns are not read, whatever their names. An empty table, or
    one without anchors, gives no rows.
    """
    own = label if isinstance(label, Column) else F.col(label)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & own.isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), own.cast("long").alias("label"), F.coalesce(F.lit(True) if anchor is None else anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    spark = vectors.sparkSession
    keys = index(rows, scale)
    if keys is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = keys.rows.filter("anchor").select("chunk", "row", "id", "label", "x")
    open_ = anchors.select("chunk", "row", "label", "x", F.array(F.lit(-NONE - 1)).alias("caps"), F.array(F.lit(NONE)).alias("floors"))
    near = search(keys, open_, positives, same=True)
    near = stored(near.select(F.col("probe"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # floor(score * high / 100) and ceil(score * low / 100), in whole numbers
    part = lambda c, p: F.floor((c * F.lit(p).cast("decimal(20,0)")) / 100).cast("long")
    exact = F.col("positive_score").cast("decimal(20,0)")
    slots = near.select("probe", "place", part(exact, high).alias("cap"), (-part(-exact, low)).alias("floor")).filter("floor <= cap")
    slots = slots.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("place", "cap", "floor"))).alias("slots"))  # at most `positives`
    slots = stored(slots, "slots")
    capped = anchors.join(slots, anchors["row"] == slots["probe"]).select("chunk", "row", "label", "x", F.col("slots.cap").alias("caps"), F.col("slots.floor").alias("floors"))
    found = search(keys, capped, negatives, same=False)
    places = slots.select(F.col("probe").alias("p"), F.posexplode("slots").alias("slot_at", "s")).select("p", "slot_at", F.col("s.place").alias("place"))
    found = found.join(places, (found["probe"] == places["p"]) & (found["slot"] == places["slot_at"])).select("probe", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("probe"), F.col("id").alias("anchor_id"))
    return found.join(near, ["probe", "place"]).join(names, "probe").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
