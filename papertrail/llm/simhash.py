"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import join_groups, membership, over_arrow, partitions, stored, utf8, with_suspects, without, word_blocks
from papertrail.llm.components import components
from papertrail.llm.decontam import shingle_hashes

SEED = 42
#: Fingerprints that may share a segment's value before they are told apart by finer segments of the other bits.
HOT = 256
#: Documents of one candidate group that a task clusters at once, and the bytes of their texts at most (or one document).
GROUP_BLOCK, GROUP_BYTES = 1000, 16 << 20
#: Documents and shingles of a block, of which two meet in a cell of the last comparison.
CELL_NODES, CELL_SHINGLES = 1000, 1 << 20
#: Fingerprints in one bucket that a task compares at once.
BUCKET = 1 << 14
#: The share of bits in which fingerprints differ at the limit of similarity: the angle between sets of Jaccard 0.8 by pi.
DIFFER = 0.152


def _sum_bits(h: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers, how many have each bit set. Bytes are added in runs of 255, which they can hold."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    out = bits[full:].sum(0, dtype=np.int64)
    return out + bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)


def _more(h: np.ndarray) -> np.ndarray:
    """64 further bits that depend on all of a hash (the finaliser of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(raw: bytes, width: int = 3, parts: int = 1, distinct: bool = False) -> list[int]:
    """The SimHash of a text in `parts` words of 64 bits.

    Shingles are runs of `width` words, repeats included or, with `distinct`, each counted once (fewer words: the whole
    sequence; none: all bits zero), hashed with XXH64 (seed 42); a bit is 1 if it is set in over half of the hashes.
    Further parts come from a mix of the hash.
    """
    n, sums, seen = 0, np.zeros((parts, 64), np.int64), np.zeros(0, np.uint64)
    for words in word_blocks(raw, width - 1):
        if not words:
            continue
        runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64)
        if distinct:
            h = np.unique(h)
            if len(raw) > 1 << 20:  # a text of several blocks
                h = np.setdiff1d(h, seen, assume_unique=True)
                seen = np.union1d(seen, h)
        n += len(h)
        for k in range(parts):
            h = h if k == 0 else _more(h)
            sums[k] += _sum_bits(h)
    return [int(np.packbits(s * 2 > n, bitorder="little").view("<i8")[0]) for s in sums]


def fingerprint_table(docs: DataFrame, *, id_col: str, text_col: str, width: int, parts: int = 1, distinct: bool = False) -> DataFrame:
    """(id, h, fp0, fp1, ...): h is a hash of the text, so that (id, h) tells rows apart that share an id."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"fp{k}" for k in range(parts)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprints(raw, width, parts, distinct) for raw in b.column(2).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "h", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(utf8(text_col)).alias("h"), utf8(text_col).alias("text"))
    return rows.mapInArrow(over_arrow(made), f"id {kind}, h long, " + ", ".join(f"{n} long" for n in names))


def segments(bits: int, shift: int, radius: int, m: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of the segments to search: two words within `radius` agree that far in one of them.

    With r = radius div m and a = radius mod m, it is enough to search a + 1 segments to radius r and the others to r - 1.
    """
    size, r, a = bits // m, radius // m, radius % m
    plan = [(shift + k * size, size if k < m - 1 else bits - k * size, r if k <= a else r - 1) for k in range(m)]
    return [x for x in plan if x[2] >= 0]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` of so many bits."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


def _value(fp: str, shift: int, bits: int) -> F.Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _entries(rows: DataFrame, plan: list[tuple[int, int, int]], carried: list[str]) -> DataFrame:
    """The table: each word under the value of each of its segments."""
    values = F.array(*(F.struct(F.lit(k).alias("seg"), _value("fp", s, b).alias("value")) for k, (s, b, _) in enumerate(plan)))
    return rows.select(*carried, F.explode(values).alias("e")).select(*carried, "e.seg", "e.value")


def _probes(rows: DataFrame, plan: list[tuple[int, int, int]], carried: list[str]) -> DataFrame:
    """The look-ups: each word under every value in the Hamming ball around each of its segments; `used` bits differ."""
    masks = [F.struct(F.lit(k).alias("seg"), F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("used")) for k, (_, b, r) in enumerate(plan) for m in ball(b, r)]
    value = F.coalesce(*(F.when(F.col("e.seg") == k, _value("fp", s, b)) for k, (s, b, _) in enumerate(plan))).bitwiseXOR(F.col("e.mask"))
    return rows.select(*carried, F.explode(F.array(*masks)).alias("e")).select(*carried, "e.seg", value.alias("value"), "e.used")


def _matched(entries: DataFrame, probes: DataFrame, on: list[str], radius: int) -> DataFrame:
    """Links of look-ups with the table. Both are shuffled: Spark's estimate of exploded rows is that of the words before,
    so that it would send many times what it allows through the driver to all workers."""
    other = entries.select(F.col("fp").alias("fp2"), *(F.col(c).alias(f"_{c}") for c in on))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    return probes.join(other.hint("merge"), [*same, near]).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def hamming_links(words: DataFrame, radius: int = 2, m: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct 64-bit words (column fp) with at most `radius` differing bits.

    Multi-index hashing: each word is tabled by its segments and looked up under the small Hamming balls around them;
    complete distances are verified within the join, so that only links leave it. Where over HOT words share a
    segment's value, the other bits are cut into segments in turn, searched to what is left of the radius: nothing is
    capped. A word has at most C(64,1) + C(64,2) links at radius 2, however many documents share it.
    """
    plan = segments(64, 0, radius, m)
    entries, probes = _entries(words, plan, ["fp"]), _probes(words, plan, ["fp"])
    hot = stored(entries.groupBy("seg", "value").count().filter(F.col("count") > HOT).select("seg", "value"), "hot")
    on = ["seg", "value"]
    if hot.limit(1).count() == 0:
        return _matched(entries, probes, on, radius)
    out = _matched(entries.join(hot, on, "left_anti"), probes.join(hot, on, "left_anti"), on, radius)
    for k, (shift, bits, most) in enumerate(plan):
        rest = [(s, b) for s, b in ((0, shift), (shift + bits, 64 - shift - bits)) if b]
        own = hot.filter(F.col("seg") == k)
        tabled = entries.join(own, on, "left_semi").select("fp", F.col("value").alias("v1"))
        asked = probes.join(own, on, "left_semi").select("fp", F.col("value").alias("v1"), F.col("used").alias("used1"))
        for left in range(radius - most, radius + 1):  # what the segment leaves of the radius
            finer = [x for s, b in rest for x in segments(b, s, left, 2 if b >= 2 else 1)]
            some = asked.filter(F.col("used1") == radius - left)
            out = out.unionByName(_matched(_entries(tabled, finer, ["fp", "v1"]), _probes(some, finer, ["fp", "v1"]), ["v1", "seg", "value"], radius))
    return out


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    fingerprint: 64 bits as 16 lower-case hex digits. Fingerprints with at most `radius` differing bits are linked;
    component_id is the smallest id that a row reaches, itself included. Links are between distinct fingerprints, so
    that a group of copies of any size is one node; rows find their component by an equi-join on the fingerprint, and
    those of very large groups don't move for it (see join_groups).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are reported each. A null id
    is never a component's smallest unless all its ids are null. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    rows = stored(fingerprint_table(docs, id_col=id_col, text_col=text_col, width=width).select("id", F.col("fp0").alias("fp")), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    found = components(hamming_links(nodes.select("fp"), radius))
    linked = found.join(nodes, found["node"] == nodes["fp"]).select("component", "fp", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.select("component", "fp").join(smallest, "component").select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select(F.col("fp").alias("node"), F.coalesce("component_id", "least").alias("component_id"), "n")
    found = join_groups(rows, stored(named, "named"), lambda r, g: r["fp"] == g["node"], "n")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def node_of(words: list[np.ndarray]) -> np.ndarray:
    """What Spark's xxhash64 gives for these columns (unsigned), as signed numbers: XXH64 of eight bytes each, the seed of
    the first being 42 and of each other the hash before it."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(words[0]), 42, np.uint64)
    for x in words:
        h = h + p5 + np.uint64(8)
        h = turned(h ^ (turned(x * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _linked_in_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, fp0, fp1, ...) sorted by key: (key, a, b), links that connect the nodes of each key within `radius`
    with the smallest that they reach, a. A node is the hash of its fingerprint (see node_of).

    A spanning set of links leaves, never all pairs. Distances of a key's rows are taken in blocks.
    """

    def near(own: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
        """Links to the smallest node that each reaches: the same ones from many keys, which are then one."""
        order = np.argsort(own, kind="stable")
        own, fps = own[order], fps[order]
        a, b, n = [], [], len(own)
        if n <= 512:
            d = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(2, dtype=np.int64) <= radius
            if int(d.sum()) == n:
                return a, b
            label = np.arange(n)
            while True:
                low = np.where(d, label[None, :], n).min(1)
                if (low == label).all():
                    break
                label = low
            at = np.flatnonzero(label != np.arange(n))
            return own[label[at]].tolist(), own[at].tolist()
        left = np.arange(n)
        while len(left):
            top, todo, left = int(own[left[0]]), [int(left[0])], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = np.bitwise_count(fps[left] ^ fps[x]).sum(1, dtype=np.int64) <= radius
                for y in left[hit].tolist():
                    a.append(top)
                    b.append(int(own[y]))
                    todo.append(y)
                left = left[~hit]
        return a, b

    carry: pa.Table | None = None

    def runs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        keys = table.column(0).to_numpy()
        words = [table.column(k).to_numpy().view(np.uint64) for k in range(1, table.num_columns)]
        node, fps = node_of(words), np.stack(words, 1)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        ends = [*cuts.tolist(), len(keys)] if last else cuts.tolist()
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        at = 0
        for end in ends:
            if end - at > 1:
                a, b = near(node[at:end], fps[at:end])
                out[0].extend([int(keys[at])] * len(a))
                out[1].extend(a)
                out[2].extend(b)
            at = end
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "a", "b"]), table.slice(at)

    for b in batches:
        table = pa.Table.from_batches([b])
        table = table if carry is None else pa.concat_tables([carry, table])
        found, carry = runs(table, False)
        yield found
    if carry is not None and carry.num_rows:
        yield runs(carry, True)[0]


def segment_plan(rows: int) -> tuple[int, int, int]:
    """(words of 64 bits of a fingerprint, bits of a segment, number of segments) for so many rows.

    Segments grow with the logarithm of the number of rows, so that some thousand fingerprints share a value however many
    there are. Longer segments of longer fingerprints are searched in more places, so that of pairs at the limit of
    similarity, where 15 % of the bits differ, 97 % and more differ in two bits at most in one segment at every size, and
    over 99 % up to 8 million rows.
    """
    size = max(16, math.ceil(math.log2(max(2, rows))) - 7)
    if size == 16:
        return 2, size, 8
    meet = sum(math.comb(size, k) * DIFFER**k * (1 - DIFFER) ** (size - k) for k in range(3))
    return 4 if size <= 20 else 8, size, math.ceil(1.5 * math.log(0.005) / math.log(1 - meet))


def _window(start: int, size: int, words: int) -> F.Column:
    """`size` bits of the words fp0, fp1, ... from a place on; behind the last comes the first."""
    word, shift = divmod(start % (64 * words), 64)
    low = F.shiftrightunsigned(f"fp{word}", shift)
    if shift + size > 64:
        low = low.bitwiseOR(F.shiftleft(f"fp{(word + 1) % words}", 64 - shift))
    return low.bitwiseAND(F.lit((1 << size) - 1))


def near_links(nodes: DataFrame, words: int, size: int, m: int) -> DataFrame:
    """(a, b): links that connect nodes (node, fp0, fp1, ...) that differ in a quarter of their bits at most, and in two
    places at most of some segment (see segment_plan).

    Each node is filed under every value in the Hamming ball of radius 1 around each segment; distances are verified in
    the buckets. A bucket of over BUCKET nodes is dealt into blocks, and each two of its blocks meet: every pair of its
    nodes is compared, at a cost that grows with the square of such a bucket. (That a node is linked doesn't spare it: it
    may be the only one that links others.)
    """
    spark, radius, fps = nodes.sparkSession, 16 * words, [f"fp{k}" for k in range(words)]
    # a key: the number of the segment above its value
    values = F.array(*(F.lit(k << size).bitwiseOR(_window(k * 64 * words // m, size, words)) for k in range(m)))
    masks = F.lit(ball(size, 1)).cast("array<bigint>")
    filed = nodes.select(F.explode(values).alias("value"), *fps).select("value", F.explode(masks).alias("mask"), *fps)
    filed = filed.select(F.col("value").bitwiseXOR(F.col("mask")).alias("key"), *fps)

    def linked(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", *fps).repartition(partitions(spark), "key").sortWithinPartitions("key")
        return dealt.mapInArrow(lambda batches: _linked_in_buckets(batches, radius), "key long, a long, b long")

    hot = stored(filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), "hot")
    if hot.limit(1).count() == 0:
        return fewer_links(linked(filed))
    blocks = F.ceil(F.col("n") / BUCKET)
    crowded = filed.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64(*fps), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = crowded.filter("mine <> other").select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), *fps)
    return fewer_links(linked(filed.join(hot, "key", "left_anti")).unionByName(linked(paired)))


def fewer_links(links: DataFrame) -> DataFrame:
    """(a, b): fewer links that connect the same nodes. What several links connect with b is connected with the smallest
    of them instead; of buckets with much the same nodes, that is much the same link."""
    ends = links.filter("a <> b").groupBy("b").agg(F.min("a").alias("least"), F.collect_set("a").alias("all"))
    others = F.transform(F.filter("all", lambda x: x != F.col("least")), lambda x: F.struct(F.col("least").alias("a"), x.alias("b")))
    return ends.select(F.explode(F.array_append(others, F.struct(F.col("least").alias("a"), F.col("b").alias("b")))).alias("x")).select("x.a", "x.b").distinct()


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingles of texts (node, text), in ascending order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(raw, width).view(np.int64) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(over_arrow(made), "node long, shingles array<long>")


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text, as hashes in ascending order; of fewer words than `width`, the whole sequence."""
    own = [np.unique(shingle_hashes(words, min(width, max(1, len(words))))) for words in word_blocks(raw, width - 1)]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def similar_pairs(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of texts (node, text) whose shingle sets have a Jaccard similarity of `least` or more.

    Exact, by prefix filter: with its shingles in order of their frequency, a set of n shares one of its first
    n - ceil(least * n) + 1 with any set that similar. Common shingles come last, so that pairs meet at rare ones.
    """
    sets = stored(_shingle_sets(texts, width), "shingles")
    table = sets.select("node", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("shingle"))
    often = table.groupBy("shingle").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("f", "shingle"))
    ranked = table.join(often, "shingle").withColumn("place", place)
    prefix = stored(ranked.filter((F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1) & (F.col("f") > 1)).select("shingle", "node", "size", "place"), "prefixes")
    b = prefix.select("shingle", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    met = prefix.withColumnRenamed("node", "a").join(b, "shingle")
    low, high = F.least("size", "size_b"), F.greatest("size", "size_b")
    most = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + F.least("place", "place_b")  # shingles that they may share
    possible = (F.col("a") < F.col("b")) & (low >= high * least - 1e-9) & (most >= (low + high) * (least / (1 + least)) - 1e-6)
    pairs = stored(met.filter(possible).select("a", "b").distinct(), "pairs")
    # Pairs are judged in cells: nodes are dealt into blocks of bounded size, and a set goes once to each cell that needs it.
    sizes = sets.agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("s")).first()
    k = max(1, -(-sizes["n"] // CELL_NODES), -(-(sizes["s"] or 0) // CELL_SHINGLES))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(0)), F.lit(k))
    cell = F.xxhash64(block("a"), block("b")).alias("cell")
    needed = pairs.select(cell, F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select("cell", "node", "shingles")
    judged = pairs.select(cell, "a", "b").groupBy("cell").cogroup(needed.groupBy("cell"))
    return judged.applyInArrow(lambda asked, held: _similar(asked, held, least), "a long, b long")


def _similar(asked: pa.Table, held: pa.Table, least: float) -> pa.Table:
    """Of pairs (cell, a, b), those whose sets (cell, node, shingles) are similar by `least` or more."""
    nodes = held.column("node").to_pylist()
    sets = {node: s.values.to_numpy() for node, s in zip(nodes, held.column("shingles"), strict=True)}
    out = []
    for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            out.append((a, b))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def independent(pairs: DataFrame) -> DataFrame:
    """(node): those that go, so that of each pair (a, b) one at least goes, and each that goes has a partner that stays.

    Rounds: a node stays if it comes before all its undecided partners in an order by hash; its partners go.
    """
    left = stored(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("w")).select("w.*").distinct(), "pairs")
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    gone = left.select(F.col("u").alias("node")).limit(0)
    while left.limit(1).count():
        first = left.groupBy("u").agg(F.min(order("v")).alias("least"))
        stay = stored(first.filter(order("u") < F.col("least")).select("u"), "stay")
        go = stored(left.join(stay, "u", "left_semi").select(F.col("v").alias("node")).distinct(), "go")
        gone = gone.unionByName(go)
        decided = stay.select(F.col("u").alias("x")).unionByName(go.select(F.col("node").alias("x")))
        left = stored(left.join(decided, F.col("u") == F.col("x"), "left_anti").join(decided, F.col("v") == F.col("x"), "left_anti"), "pairs")
    return gone


def followers(sets: list[np.ndarray], least: float) -> list[bool]:
    """Which of these shingle sets follow a leader: one before them that leads and is similar by `least` or more.

    A set that follows none leads itself; an empty set neither leads nor follows. By prefix filter: with shingles in
    order of their frequency here, similar sets meet in their first n - ceil(least * n) + 1; meetings are judged exactly.
    """
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    distinct, at, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, count))] = np.arange(len(distinct))
    shared = np.sort(count) > 1  # by rank
    out, index, end = [], {}, 0
    for i, own in enumerate(sets):
        start, end = end, end + len(own)
        prefix = np.sort(rank[at[start:end]])[: len(own) - math.ceil(least * len(own) - 1e-9) + 1] if len(own) else rank[:0]
        prefix = prefix[shared[prefix]].tolist()
        for j in dict.fromkeys(j for x in prefix for j in index.get(x, ())):
            low, high = sorted((len(own), len(sets[j])))
            if low >= high * least - 1e-9:
                both = len(np.intersect1d(own, sets[j], assume_unique=True))
                if both >= least * (low + high - both) - 1e-9:
                    out.append(True)
                    break
        else:
            out.append(False)
            for x in prefix:
                index.setdefault(x, []).append(i)
    return out


def _clustered(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (group, block, id, h, text) sorted by group, block, id: whether each follows a leader of its block."""
    now, rows, sets = None, [], []
    names, types = ["group", "id", "h", "led"], None

    def judged() -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), followers(sets, least)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        types = [b.column(0).type, b.column(2).type, b.column(3).type, pa.bool_()]
        for group, block, key, h, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (group, block):
                if rows:
                    yield judged()
                now, rows, sets = (group, block), [], []
            rows.append((group, key, h))
            sets.append(shingle_set(raw, width))
    if rows:
        yield judged()


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were, however they are named.

    Candidates: SimHash fingerprints of 128 bits (more beyond 8 million rows, see `segment_plan`) over the distinct
    shingles of `width` words, since similarity is that of sets: a passage counts once however often it is repeated. They
    are linked by multi-index hashing (`near_links`). At a similarity of 0.8 the expected distance is 19.4 of 128 bits,
    well below the radius of 32; false candidates cost a comparison, since all are judged exactly.

    Verification: within the components of these links a row is dropped if its shingle set has a Jaccard similarity of
    `least` or more with a row that stays. A component is clustered in the order of ids; one of over 1,000 rows or 16 MB
    is dealt into blocks by hash, whose leaders meet in a next round as long as rounds drop a fifth of such rows; then all
    pairs of their leaders are found by an exact join (`similar_pairs`). So no two rows that stay in a component are that
    similar, whatever its size.

    Rows are told apart by id (of any type) and text; rows that agree in both stay or go together (the exact stage comes
    before this one). Null and empty texts have no shingles and are similar to nothing: all stay, as does any row with a
    null in other columns that is no near duplicate. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    words, size, m = segment_plan(docs.count())
    fps = [f"fp{k}" for k in range(words)]
    rows = stored(fingerprint_table(docs, id_col=id_col, text_col=text_col, width=width, parts=words, distinct=True), "wide")
    nodes = stored(rows.groupBy(*fps).agg(F.count("*").alias("n")).withColumn("node", F.xxhash64(*fps)), "nodes")
    copies = nodes.filter("n > 1").select("node", F.col("node").alias("component"))
    found = components(near_links(nodes.select("node", *fps), words, size, m))
    groups = found.unionByName(copies.join(found, "node", "left_anti"))
    named = stored(nodes.join(groups, "node").select(F.col("node").alias("of"), F.col("component").alias("group"), "n"), "groups")
    members = join_groups(rows.select("id", "h", F.xxhash64(*fps).alias("node")), named, lambda r, g: r["node"] == g["of"], "n").filter("group is not null")
    members = stored(members.select("id", "h", "group").distinct(), "members")
    h = F.xxhash64(utf8(text_col))
    texts = docs.select(F.col(id_col).alias("id"), h.alias("h"), utf8(text_col).alias("text"))
    key = lambda: F.xxhash64("id", "h")
    suspects = with_suspects(texts, membership(members.select(key().alias("m")), "m"), key()).filter("_suspect").drop("_suspect")
    m2 = members.select(F.col("id").alias("i"), F.col("h").alias("g"), "group")
    same = lambda: F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    alive = stored(suspects.join(m2, same()).select("group", "id", "h", "text").dropDuplicates(["id", "h"]), "candidates")
    gone: DataFrame | None = None
    turn = 0
    while True:
        sizes = alive.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES)).alias("blocks"))
        sizes = stored(sizes, "sizes")
        dealt = alive.join(sizes, "group").select("group", F.pmod(F.xxhash64("id", "h", F.lit(turn)), "blocks").alias("block"), "id", "h", "text")
        ordered = dealt.repartition(partitions(spark), "group", "block").sortWithinPartitions("group", "block", "id", "h")
        judged = stored(ordered.mapInArrow(over_arrow(lambda batches: _clustered(batches, width, least)), f"group long, id {kind}, h long, led boolean"), "judged")
        led = judged.filter("led").select("id", "h")
        gone = led if gone is None else gone.unionByName(led)
        large = sizes.filter("blocks > 1").select("group")
        if large.limit(1).count() == 0:
            break
        crowd = judged.join(large, "group", "left_semi")
        next_up = crowd.filter("not led").select(F.col("id").alias("i"), F.col("h").alias("g"))
        alive = stored(alive.join(next_up, same(), "left_semi"), "leaders")
        if crowd.agg(F.sum(F.col("led").cast("int")) * 5 < F.count("*")).first()[0]:
            numbered = stored(alive.select("id", "h", "text", F.monotonically_increasing_id().alias("node")), "numbered")
            go = independent(similar_pairs(numbered, width, least))
            gone = gone.unionByName(numbered.join(go, "node", "left_semi").select("id", "h"))
            break
        turn += 1
    return without(docs, stored(gone.distinct(), "gone"), {"id": F.col(id_col), "h": h})
