"""Packing documents into training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow, utf8
from papertrail.llm.tokens import vocabulary_path, word_encoder

#: A block that is packed on its own holds so many documents at most, and closes at so many ids.
BLOCK_DOCS, BLOCK_IDS = 1500, 1 << 22
#: What is left of a document that had to be cut anyway comes in pieces of at least so many ids, which level the windows.
CRUMB = 32
CUT_FROM = 1024


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of item numbers with nearly equal sums of sizes: multiway differencing.

    Each item begins as a partial partition of its own. The two partial partitions with the largest spread are merged,
    the heaviest windows of one onto the lightest of the other, until one is left.
    """
    tree: list[tuple[int, int]] = []  # node n + j joins two nodes; nodes below n are items
    n, order = len(sizes), np.argsort(-np.asarray(sizes), kind="stable")
    falling = np.asarray(sizes)[order]
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # of partial partitions: minus the spread, a tie-break, sums over zero in falling order, their nodes
    at = turn = 0

    def push(sums: np.ndarray, nodes: np.ndarray) -> None:
        nonlocal turn
        low, turn = int(sums[-1]) if len(sums) == k else 0, turn + 1
        heapq.heappush(heap, (low - int(sums[0]), turn, sums - low if low else sums, nodes))

    def item() -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        at += 1
        return falling[at - 1 : at], order[at - 1 : at]

    while at < n or len(heap) > 1:
        top = -heap[0][0] if heap else -1
        if at < n and falling[at] >= top:
            # Items merge with items as long as none of the partitions has a larger spread: until the new one has k of
            # them, its spread is its first item, which is the largest of all.
            end = min(n, at + k, at + int(np.searchsorted(-falling[at:], -top, side="right")))
            a, na, at = falling[at:end], order[at:end], end
            if len(a) == k or not heap:
                push(a, na)
                continue
            b, nb = heapq.heappop(heap)[2:]
        else:
            a, na = heapq.heappop(heap)[2:]
            b, nb = item() if at < n and (not heap or falling[at] >= -heap[0][0]) else heapq.heappop(heap)[2:]
        both = len(a) + len(b) - k
        if both > 0:  # heavy on light: the windows that meet are the lightest of either
            keep = len(a) - both
            met = a[keep:] + b[len(b) - both :][::-1]
            nodes = np.arange(n + len(tree), n + len(tree) + both)
            tree.extend(zip(na[keep:].tolist(), nb[len(b) - both :][::-1].tolist(), strict=True))
            a, na = np.concatenate([a[:keep], met, b[: len(b) - both]]), np.concatenate([na[:keep], nodes, nb[: len(b) - both]])
        else:
            a, na = np.concatenate([a, b]), np.concatenate([na, nb])
        sort = np.argsort(-a, kind="stable")
        a, na = a[sort], na[sort]
        push(a, na)
    windows = []
    for node in heap[0][3].tolist() if n else []:
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo.extend(tree[x - n])
        windows.append(sorted(items))
    return windows


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing fits into capacity: the count rises whenever a window exceeds it."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def pieces(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Cut documents: (document, start, length) of full windows, and of the items that remain to be packed."""
    full, items = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [(d, j * capacity, capacity) for j in range(whole)]
        at = whole * capacity
        crumb = CRUMB
        while n - at > crumb and (whole or n >= CUT_FROM):  # such a document is in pieces already
            items.append((d, at, crumb))
            at, crumb = at + crumb, crumb * 2
        if n > at:
            items.append((d, at, n - at))
    return full, items


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 1, capacity: int = 2048, with_ids: bool = True, lean: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (as
    little-endian unsigned 32-bit numbers) if asked for. With `lean`, tasks spend some time to hold less memory.

    Every text is encoded whole and gets `end`; each of its ids lies in exactly one piece. Documents of a capacity or
    more give full windows; what remains is packed by Karmarkar-Karp multiway differencing in blocks of at most 1,500
    documents of one input partition. No shuffle, and a task holds one block. Null and empty texts are the end id alone;
    repeated rows are packed each; a null id stays null; other columns are not read, whatever their names; an empty
    table gives no rows. Sequence numbers are unique, not dense: the input partition and a count within it.
    """
    vocab = vocabulary or vocabulary_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, last = word_encoder(vocab), np.array([end], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40

        def block(keys: list, texts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(t) // 4 for t in texts]
            full, items = pieces(lengths, capacity)
            rows = []
            for p in full:
                rows.append((*p, sequence, 0))
                sequence += 1
            for w in windows_for([x[2] for x in items], capacity) if items else []:
                at = 0
                for i in w:
                    rows.append((*items[i], sequence, at))
                    at += items[i][2]
                sequence += 1
            d, start, length, seq, offset = zip(*rows, strict=True)
            ids = [texts[i][4 * s : 4 * (s + n)] for i, s, n in zip(d, start, length, strict=True)]
            long = lambda x: pa.array(x, pa.int64())
            columns = [pa.array([keys[i] for i in d], id_type), long(start), long(length), long([zlib.crc32(x) for x in ids]), long([lengths[i] for i in d]), long(seq), long(offset)]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=names)

        keys: list = []
        texts: list[bytes] = []
        held, id_type = 0, None
        for b in batches:
            id_type = b.column(0).type
            for key, own in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                keys.append(key)
                texts.append(own + last)
                held += len(texts[-1]) // 4
                if len(keys) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield block(keys, texts, id_type)
                    keys, texts, held = [], [], 0
        if keys:
            yield block(keys, texts, id_type)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    out = rows.mapInArrow(over_arrow(packed, lean), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)
