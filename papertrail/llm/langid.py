"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from papertrail.llm.common import kept, over_arrow

#: The labelled sample: so many distinct documents of each language at most, so many characters of each document, and so
#: many characters of each language; of all languages together not more than the last.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_CHARS, ALL_CHARS = 200, 600, 40_000, 640_000
#: A language's most frequent characters have a column of a dense table; its transitions on all others are looked up in a
#: sorted list. This decides where a transition is kept, not which there are.
DENSE = 63
#: A text is parsed in windows of so many characters, all windows of a batch side by side.
WINDOW = 1024
#: What a character costs that a language's reference doesn't have, in bits: any code point.
UNKNOWN_BITS = 21
_RARE = 255


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton of all substrings of a sequence; states count from 1, 1 is the root."""
    to: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols:
        new = len(to)
        to.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


class Reference:
    """A language's automaton over all characters of its reference, as tables."""

    def __init__(self, symbols: np.ndarray, all_symbols: int) -> None:
        seen, counts = np.unique(symbols, return_counts=True)
        order = seen[np.argsort(-counts, kind="stable")]
        frequent = order[:DENSE].tolist()
        self.column = np.zeros(all_symbols, np.uint8)  # 0: not in the reference
        self.column[seen] = _RARE
        self.column[frequent] = np.arange(1, len(frequent) + 1)
        self.width, self.all_symbols = len(frequent) + 1, all_symbols
        states = suffix_automaton(symbols.tolist())
        dense = np.zeros((len(states), self.width), np.int32)
        own = {c: i + 1 for i, c in enumerate(frequent)}
        keys, ends = [], []
        for s, steps in enumerate(states):
            for c, t in steps.items():
                if c in own:
                    dense[s, own[c]] = t
                else:
                    keys.append(s * all_symbols + c)
                    ends.append(t)
        self.dense = dense.ravel()
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ends = np.array(keys, np.int64)[at], np.array(ends, np.int32)[at]
        self.first = dense[1]
        self.log_size = float(np.log2(max(2, len(symbols))))

    def rare_steps(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        wanted = states * np.int64(self.all_symbols) + symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ends[at], 0).astype(np.int32)

    def phrases(self, grid: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of lanes (columns of grid, of which the first live[t] have a t-th symbol): phrases, and unknown symbols among them."""
        columns = self.column[grid]
        rare = (columns == _RARE).any(1)
        state, count = np.ones(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int32)
        unknown = np.zeros(grid.shape[1], np.int32)
        for t in range(len(grid)):
            w = live[t]
            c, s = columns[t, :w], state[:w]
            if rare[t]:
                own = np.flatnonzero(c == _RARE)
                c = c.copy()
                c[own] = 0
                to, first = self.dense[s * np.int64(self.width) + c], self.first[c]
                symbols = grid[t, own].astype(np.int64)
                to[own] = self.rare_steps(s[own], symbols)
                first[own] = self.rare_steps(np.ones(len(own), np.int64), symbols)
            else:
                to, first = self.dense[s * np.int64(self.width) + c], self.first[c]
            cut = to == 0
            count[:w] += cut | (s == 1)  # at the root a phrase has ended, or none has begun
            unknown[:w] += first == 0
            state[:w] = np.where(cut, np.where(first > 0, first, 1), to)
        return count, unknown


class CrossParser:
    """Counts the phrases into which texts fall when each is the longest match with a language's reference text.

    All characters of the references are known; one that a language's reference lacks is a phrase of its own there.
    """

    def __init__(self, references: dict[str, str]) -> None:
        self.languages = sorted(references)
        own = sorted(set().union(*references.values()))
        self.symbols = np.zeros(0x110000, np.uint32)
        self.symbols[[ord(c) for c in own]] = np.arange(1, len(own) + 1)
        self.tables = [Reference(self.symbols[_code_points(references[lang])], len(own) + 1) for lang in self.languages]
        self.log_size = np.array([t.log_size for t in self.tables])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text (row) in every language (column), and how many of them are unknown characters."""
        codes = [self.symbols[_code_points(t.lower())] for t in texts]
        owner = np.concatenate([np.full(-(-len(c) // WINDOW), i) for i, c in enumerate(codes)] or [np.zeros(0)]).astype(np.int64)
        lanes = [c[k : k + WINDOW] for c in codes for k in range(0, len(c), WINDOW)]
        out, unknown = (np.zeros((len(texts), len(self.languages)), np.int64) for _ in range(2))
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        sizes = np.array([len(lanes[i]) for i in order], np.int64)
        step = 4096
        for a in range(0, len(lanes), step):
            own, n = order[a : a + step], sizes[a : a + step]
            grid = np.zeros((int(n[0]), len(own)), np.uint32)
            for j, i in enumerate(own.tolist()):
                grid[: n[j], j] = lanes[i]
            live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")  # lanes that have a t-th symbol
            for k, table in enumerate(self.tables):
                count, missing = table.phrases(grid, live)
                np.add.at(out[:, k], owner[own], count)
                np.add.at(unknown[:, k], owner[own], missing)
        return out, unknown

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language with the fewest normalised phrases, and a score: 1/2 if the next one needs as few, 1 if far more.

        A phrase costs the logarithm of the reference's size, an unknown character the same in every language. Of
        languages that cost the same the one with the longer reference wins, then the first by name.
        """
        full = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(full), [0.0] * len(full)
        count, unknown = self.phrases(full)
        size = np.array([max(1, len(t)) for t in full])[:, None]
        rate = ((count - unknown) * self.log_size + unknown * UNKNOWN_BITS) / size  # bits per character: an estimate of the cross entropy
        rank = np.argsort(-self.log_size, kind="stable")  # ties: larger references first, names are sorted already
        langs, scores = [], []
        for t, r in zip(full, rate, strict=True):
            if not has_letter(t):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(rank[np.argmin(r[rank])])
            rest = np.delete(r, best)
            langs.append(self.languages[best])
            scores.append(float(rest.min() / (rest.min() + r[best])) if len(rest) else 1.0)
        return langs, scores


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def labelled_sample(docs: DataFrame, learn_from: Column, *, text_col: str, lang_col: str) -> dict[str, str]:
    """Reference texts by language from a bounded sample of the labelled rows: see SAMPLE_DOCS and the figures beside it.

    Distinct texts are taken in the order of a hash, so that the sample depends neither on partitions nor on ids, and
    copies count once; of each text a stretch that the hash places. The first pass over the rows only counts hashes by
    their magnitude (a power of two), and finds for each language up to which one there are enough; the second fetches
    the stretches of these texts, some hundred a language.
    """
    text = F.col(text_col)
    at = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS)).cast("int") + 1
    labelled = docs.filter(learn_from & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"), text.substr(at, F.lit(SAMPLE_CHARS)).alias("part"))
    rows = rows.withColumn("magnitude", F.length(F.bin("h")))
    counts = rows.select("lang", "h", "magnitude").distinct().groupBy("lang", "magnitude").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("magnitude"))
    enough = counts.withColumn("n", up_to).groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("n") >= SAMPLE_DOCS, F.col("magnitude"))), F.max("magnitude")).alias("enough"))
    near = rows.join(F.broadcast(enough), "lang").filter("magnitude <= enough")  # one row a label
    fetched = near.groupBy("lang", "h").agg(F.min("part").alias("part"))
    ranked = fetched.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= SAMPLE_DOCS)
    parts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "k").toLocalIterator():
        parts.setdefault(r["lang"], []).append(r["part"].lower())
    bound = min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(parts)))
    return {lang: "\n".join(p)[:bound] for lang, p in parts.items()}


def identify(docs: DataFrame, references: dict[str, str], *, text_col: str = "text", keep: bool = False) -> DataFrame:
    """docs' columns and lang_pred, score (with keep: docs' own columns only, of rows whose language isn't `und`; where
    nothing was learned, of rows with a letter).

    One pass, no shuffle: the reference texts (at most 640,000 characters) are broadcast and each Python worker builds
    their automata once. Whole texts are parsed, in windows of 1,024 characters; a window's end ends a phrase in every
    language alike. lang_pred is `und` and score 0 if the text is null, empty or has no letter, or nothing was learned.
    Repeated rows are judged each; nulls in other columns stay; columns of docs that are named lang_pred or score give
    way to the new ones (with keep, nothing is added and they stay); an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(references.items())))
    if not keep:
        docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    at = docs.columns.index(text_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kept(sent.value, lambda: CrossParser(dict(sent.value)))
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores = parser.predict(texts)
            if keep:
                known = [x != "und" or (not parser.languages and has_letter(t or "")) for x, t in zip(langs, texts, strict=True)]
                yield b.filter(pa.array(known, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.schema if keep else StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(over_arrow(judged), schema)
