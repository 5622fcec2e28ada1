"""Language-model scores by subword lattice likelihood."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow, stored, utf8, word_blocks
from papertrail.llm.tokens import vocabulary_path

#: Counted words go to the executors with their counts if they are among so many most frequent (or fewer); all others by a join.
FREQUENT = 1 << 17
#: Longer words than this are never among them, so that they take 8 MB at most.
FREQUENT_BYTES = 64
#: Words of more bytes are handled one by one, shorter ones side by side.
LONG = 256
#: Words that a task gathers: before it hands its counts on, and to handle side by side.
HELD = 300_000
#: Expectation-maximisation steps over the corpus, from the vocabulary's own weights.
STEPS = 2
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def word_counts(docs: DataFrame, *, text_col: str) -> DataFrame:
    """(word, n): how often each lower-cased word occurs in all texts. Tasks count before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                for words in word_blocks(raw):
                    held.update(words)
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.select(utf8(text_col).alias("text")).mapInArrow(over_arrow(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pieces:
    """A vocabulary of subword pieces with probabilities, and the forward recursion over all segmentations of words.

    A word is its UTF-8 bytes behind a blank; a piece is such bytes too. Every byte is a piece by itself, so that any
    text has a segmentation. Prefix hashes give every substring's number without making it. Lattices of short words of
    similar length are handled side by side; a long word's is one pass along its arcs, of which each place has as many as
    pieces end there, so that time and memory grow in proportion to its length.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = list(dict.fromkeys([bytes([i]) for i in range(256)] + pieces))
        self.longest = max(map(len, self.pieces))
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], order.astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        bucket = (self.keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.start).max())

    @staticmethod
    def _key(p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return (h * int(_MIX)) & 0xFFFFFFFFFFFFFFFF

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1."""
        key = h * _MIX
        slot = (key >> np.uint64(64 - _SLOTS)).astype(np.int64)
        lo, hi = self.start[slot], self.start[slot + 1]
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(hi > lo)
        for k in range(self.deepest):
            i = lo[some] + k
            ok = i < hi[some]
            some, i = some[ok], i[ok]
            same = self.keys[i] == key[some]
            out[some[same]] = self.at[i[same]]
        return out

    def _arcs(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (rows of bytes): (from, to, words that have the arc, its piece), by end."""
        n, size = words.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * _BASE + words[:, j] + np.uint64(1)
        arcs = []
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                found = self.find(prefix[j] - prefix[i] * self.powers[j - i])
                own = np.flatnonzero(found >= 0)
                if len(own):
                    arcs.append((i, j, own, found[own]))
        return arcs

    @staticmethod
    def blocks(words: list[bytes], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words' places, lengths, rows of bytes) of short words, in blocks of bounded size. Rows are as long as the next
        power of two, and what lies behind a word is no byte."""
        short = [(i, b" " + w) for i, w in enumerate(words) if len(w) < LONG]
        owner = np.array([i for i, _ in short], np.int64)
        sizes = np.array([len(x) for _, x in short], np.int64)
        width = np.int64(1) << np.ceil(np.log2(np.maximum(4, sizes))).astype(np.int64)
        for size in np.unique(width).tolist():
            own = np.flatnonzero(width == size)
            step = max(1, most // (8 * (size + 1)))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                longest = int(sizes[part].max())
                raw = b"".join(short[i][1].ljust(longest, b"\0") for i in part.tolist())
                rows = np.frombuffer(raw, np.uint8).reshape(len(part), longest).astype(np.uint64)
                rows[np.arange(longest) >= sizes[part][:, None]] = 1 << 20
                yield owner[part], sizes[part], rows

    def _arcs_of_long(self, word: bytes, block: int = 1 << 16) -> Iterator[np.ndarray]:
        """Arcs of a word (rows: from, to, piece), by end, in blocks of its places."""
        raw = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        for a in range(0, len(raw), block):
            first, end = max(0, a - self.longest), min(len(raw), a + block)
            prefix = np.zeros(end - first + 1, np.uint64)
            h = 0
            for k, c in enumerate(raw[first:end].tolist(), 1):
                h = (h * int(_BASE) + c) & 0xFFFFFFFFFFFFFFFF
                prefix[k] = h
            starts, ends, pieces = [], [], []
            for size in range(1, self.longest + 1):
                j = np.arange(max(a + 1, size), end + 1)
                j = j[j - size >= first]
                found = self.find(prefix[j - first] - prefix[j - size - first] * self.powers[size])
                own = np.flatnonzero(found >= 0)
                starts.append(j[own] - size)
                ends.append(j[own])
                pieces.append(found[own])
            arcs = np.array([np.concatenate(x) for x in (starts, ends, pieces)], np.int32)
            yield arcs[:, np.argsort(arcs[1], kind="stable")]

    def _alpha_of_long(self, word: bytes, logp: list[float]) -> list[float]:
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = 0.0
        for arcs in self._arcs_of_long(word):
            for i, j, p in zip(*arcs.tolist(), strict=True):
                new, old = alpha[i] + logp[p], alpha[j]
                if new == -math.inf:
                    continue
                alpha[j] = new if old == -math.inf else new + math.log1p(math.exp(old - new)) if new > old else old + math.log1p(math.exp(new - old))
        return alpha

    def forward(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """The natural logarithm of each word's probability: the sum over all its segmentations."""
        out = np.zeros(len(words))
        for owner, sizes, rows in self.blocks(words):
            out[owner] = self._alpha(rows, self._arcs(rows), logp)[sizes, np.arange(len(sizes))]
        plain = logp.tolist()
        for n, w in enumerate(words):
            if len(w) >= LONG:
                out[n] = self._alpha_of_long(b" " + w, plain)[-1]
        return out

    @staticmethod
    def _alpha(rows: np.ndarray, arcs: list, logp: np.ndarray) -> np.ndarray:
        alpha = np.full((rows.shape[1] + 1, rows.shape[0]), -np.inf)
        alpha[0] = 0
        for i, j, own, piece in arcs:
            alpha[j, own] = np.logaddexp(alpha[j, own], alpha[i, own] + logp[piece])
        return alpha

    def expected(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words' segmentations, weighted by their probability."""
        out = np.zeros(len(self.pieces))
        for _, sizes, rows in self.blocks(words):
            arcs = self._arcs(rows)
            alpha = self._alpha(rows, arcs, logp)
            each = np.arange(len(sizes))
            whole = alpha[sizes, each]
            beta = np.full_like(alpha, -np.inf)
            beta[sizes, each] = 0
            for i, j, own, piece in reversed(arcs):
                step = logp[piece] + beta[j, own]
                np.add.at(out, piece, np.exp(alpha[i, own] + step - whole[own]))
                beta[i, own] = np.logaddexp(beta[i, own], step)
        plain = logp.tolist()
        for w in words:
            if len(w) >= LONG:
                self._expect_long(b" " + w, plain, out)
        return out

    def _expect_long(self, word: bytes, logp: list[float], out: np.ndarray) -> None:
        alpha = self._alpha_of_long(word, logp)
        whole, beta = alpha[-1], [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for arcs in reversed(list(self._arcs_of_long(word))):
            for i, j, p in zip(*arcs[:, ::-1].tolist(), strict=True):
                step, old = logp[p] + beta[j], beta[i]
                if step == -math.inf:
                    continue
                out[p] += math.exp(alpha[i] + step - whole)
                beta[i] = step if old == -math.inf else step + math.log1p(math.exp(old - step)) if step > old else old + math.log1p(math.exp(step - old))


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece vocabulary as lower-case bytes, and the weights that its scores give them.

    The scores of this vocabulary are ranks: a piece weighs the inverse of its rank (Zipf's law). Pieces that differ only
    in the case of A-Z are one, as the texts are lower-cased. Single bytes share the weight of one more piece.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(library.get_piece_size()):
        if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            p = library.id_to_piece(i).replace("▁", " ").encode().lower()
            if b" " not in p[1:] and not any(c in b"\t\n\x0b\x0c\r" for c in p):
                weight[p] = weight.get(p, 0.0) + 1 / (1 - library.get_score(i))
    names = list(weight)
    every = [bytes([i]) for i in range(256)]
    for b in every:
        weight[b] = weight.get(b, 0.0) + 1 / 256
    order = list(dict.fromkeys(every + names))
    w = np.array([weight[p] for p in order])
    return order[256:], np.log(w / w.sum())


def fit_pieces(counts: DataFrame, pieces: list[bytes], logp: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the pieces, re-estimated on the corpus's distinct words by expectation maximisation.

    Each step is one pass over the word counts; what comes to the driver is one number for each piece.
    """
    spark = counts.sparkSession
    for _ in range(steps):
        sent = spark.sparkContext.broadcast((pieces, logp))

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, p = sent.value
            model, total, held = Pieces(names), np.zeros(len(p)), []
            for b in batches:
                held += b.column(0).to_pylist()
                if len(held) >= HELD:
                    total += model.expected(held, p)
                    held = []
            total += model.expected(held, p)
            if total.any():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "n"])

        rows = counts.select("word").mapInArrow(over_arrow(expected), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(len(logp), 1e-3)
        for r in rows:
            n[r["piece"]] += r["n"]
        logp = np.log(n / n.sum())
    return logp


def _least_frequent(counts: DataFrame) -> int:
    """A count that at most FREQUENT words of few bytes reach, from a histogram of counts in eighths of powers of two: a few
    hundred rows."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    taken, least = 0, 1 << 62
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        taken += r["words"]
        if taken > FREQUENT:
            break
        least = r["least"]
    return least


def score(docs: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row for every row of docs: id, n_tokens, n_known, train_tokens, base_score, score; scores are log10.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and one end. Counts are those of the rows where
    learn_from is true (null counts as false), all of them. base_score adds one to each count, as in (c+1)/(N+V+1).

    The model is a lattice over each word: its arcs are the pieces of an existing vocabulary, and the words of the corpus
    itself. A word arc weighs c/(N+V); the pieces share the rest, V/(N+V), with weights that start from the vocabulary's
    scores and are re-estimated on the distinct words of the corpus. The forward recursion adds up all segmentations in
    log space. No piece crosses the blank in front of a word, so a text's marginal probability is the product of its
    words' and its end's.

    Counts of the most frequent words, at most 131,072 of at most 64 bytes, go to every task; each other word of a text is
    joined with its count: hot words are never a join key. Tasks hold a batch of texts, the pieces and their counts.
    Null and empty texts have one token, the end. Nothing learned: every count is 0. Repeated rows are scored each; a null id stays null; other columns
    are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = model or vocabulary_path("piece_bpe_32k.model")
    training = docs.filter(F.coalesce(learn_from, F.lit(False)))
    counts = stored(word_counts(training, text_col=text_col), "words")
    ends = training.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    pieces, logp = vocabulary_pieces(path)
    if total:
        logp = fit_pieces(counts, pieces, logp)
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    frequent = {bytes(r["word"]): r["n"] for r in short.filter(F.col("n") >= _least_frequent(short)).collect()}
    sent = spark.sparkContext.broadcast((pieces, logp, frequent))
    base_all = np.log10(total + distinct + 1)
    words_share = total + distinct

    def base_of(c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1) - base_all

    log_rest = np.log10(distinct / words_share) if total else 0.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p, often = sent.value
        lattice = Pieces(names)
        own_base = {w: float(base_of(np.float64(c))) for w, c in often.items()}
        often_words = list(often)
        q = lattice.forward(often_words, p) / np.log(10)
        own_score = {w: float(np.log10(often[w] / words_share + 10.0 ** (log_rest + x))) for w, x in zip(often_words, q.tolist(), strict=True)}
        end_base = float(base_of(np.float64(ends)))
        end_score = float(np.log10(ends / words_share)) if ends else -base_all
        for b in batches:
            n, known, base, full, rare = [], [], [], [], []
            for raw in b.column(1).to_pylist():
                tokens, k, x, y, own = 1, int(ends > 0), end_base, end_score, Counter()
                for words in word_blocks(raw):
                    tokens += len(words)
                    for w, c in Counter(words).items():
                        s = own_base.get(w)
                        if s is None:
                            own[w] += c
                        else:
                            x, y, k = x + c * s, y + c * own_score[w], k + c
                n.append(tokens)
                known.append(k)
                base.append(x)
                full.append(y)
                rare.append(own)
            distinct_rare = list(set().union(*rare))
            at = dict(zip(distinct_rare, (lattice.forward(distinct_rare, p) / np.log(10)).tolist(), strict=True)) if distinct_rare else {}
            sizes = [len(o) for o in rare]
            flat = [(w, c, at[w]) for o in rare for w, c in o.items()]
            w, c, s = zip(*flat, strict=True) if flat else ((), (), ())
            struct = pa.StructArray.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int32()), pa.array(s, pa.float64())], names=["word", "c", "q"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(full), pa.ListArray.from_arrays(offsets, struct)], names=["id", "n_tokens", "k", "base", "full", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    rows = rows.mapInArrow(over_arrow(scored), f"id {kind}, n_tokens long, k long, base double, full double, rare array<struct<word:binary,c:int,q:double>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.c", "x.q").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    spelled = F.col("q") + F.lit(float(log_rest))
    whole = F.log10(n / F.lit(float(words_share)))  # null for a word that wasn't learned
    more, less = F.greatest(whole, spelled), F.least(whole, spelled)
    # in log space, since the spelling of a long word is less likely than the smallest double
    each = F.when(n > 0, more + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), less - more))).otherwise(spelled) if total else F.col("q")
    summed = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("c")).otherwise(0)).alias("k2"), F.sum(F.col("c") * (F.log10(n + 1) - F.lit(float(base_all)))).alias("base2"), F.sum(F.col("c") * each).alias("full2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rare").join(summed, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("k") + zero("k2")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"),
        (F.col("full") + zero("full2")).alias("score"),
    )
