import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papertrail.llm import dac, packing, token_store
from papertrail.llm.token_count import token_counts
from papertrail.llm.tokens import PieceCounter, WordEncoder, vocabulary_path
from tests.llm.conftest import ROWS

ODD_TEXT = st.lists(st.sampled_from(list("abcTHE .,'’é́ẞİſ日\n\t\r\x00\x1c\x85\xa0▁😀0½²<|>/s_#") + ["the", " the", "  ", "tion", "<s>", "</s>", "<|endoftext|>", "<|startoftext|>", "'s", "'LL"]), max_size=40).map("".join)
COUNTER = PieceCounter(vocabulary_path("piece_bpe_32k.model"))
ENCODER = WordEncoder(vocabulary_path("word_bpe_49k.json"))


@given(ODD_TEXT)
@settings(max_examples=1500, deadline=None)
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(COUNTER.library.encode(text))


@given(ODD_TEXT)
@settings(max_examples=1500, deadline=None)
def test_ids_equal_the_library(text):
    raw = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    assert np.frombuffer(ENCODER.encode([raw.encode()])[0], "<u4").tolist() == ENCODER.library.encode(raw, add_special_tokens=False).ids


def test_whole_tokens_are_proved():
    assert len(COUNTER.whole) > 10_000 and all(len(COUNTER.library.encode(w)) == 1 for w in list(COUNTER.whole)[::500])


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr("papertrail.llm.tokens.CACHED", 50)
    small, counter = WordEncoder(vocabulary_path("word_bpe_49k.json")), PieceCounter(vocabulary_path("piece_bpe_32k.model"))
    for k in range(5):
        text = " ".join(f"word{k}x{i}," for i in range(100))
        assert np.frombuffer(small.encode([text.encode()])[0], "<u4").tolist() == small.library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(counter.library.encode(text))


def test_token_counts(docs, odd, none):
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        got = token_counts(df).collect()
        assert len(got) == df.count()
        for r in got:
            t = text[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(COUNTER.library.encode(t)))
            assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts(none).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1300), st.data())
@settings(max_examples=60, deadline=None)
def test_random_access(ids, data):
    r = dac.Reader(dac.encode(np.array(ids, np.uint32)))
    assert len(r) == len(ids) and r.slice(0, len(ids)).tolist() == ids
    if ids:
        a = data.draw(st.integers(0, len(ids) - 1))
        b = data.draw(st.integers(a, len(ids)))
        assert r.slice(a, b).tolist() == ids[a:b] and r.get(a) == ids[a]
    with pytest.raises(IndexError):
        r.get(len(ids))


def encoded(text, end):
    return [*ENCODER.library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_files_round_trip(docs, odd, none, monkeypatch, size):
    monkeypatch.setattr(token_store, "FILE_IDS", size)
    for df in (docs, odd):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
        want, at = [], 0
        for known, i, t in rows:
            ids = encoded(t, 2)
            want.append((i if known else None, at, len(ids), crc(ids)))
            at += len(ids)
        got = [tuple(r) for r in token_store.token_files(df).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.token_files(none).count() == 0


def test_ids_come_back(spark, docs, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"))
    got = {r["doc_id"]: r["token_ids"] for r in token_store.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert all(got[r["doc_id"]] == encoded(r["text"], 2) for r in docs.collect())


def plain_differencing(sizes, k):
    parts = [(-s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    n = len(parts)
    while len(parts) > 1:
        parts.sort()
        (_, _, a), (_, _, b), *parts = parts
        both = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        n += 1
        parts.append((both[-1] - both[0], n, [x - both[-1] for x in both]))
    return max(parts[0][2]) - min(parts[0][2])


def test_differencing():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.choice(2000, rng.integers(1, 40), replace=False).tolist()
        sizes = [s + 1 for s in sizes]
        k = int(rng.integers(1, 10))
        windows = packing.difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) <= k
        sums = [sum(sizes[i] for i in w) for w in windows] + [0] * (k - len(windows))
        assert max(sums) - min(sums) == plain_differencing(sizes, k)
        assert all(sum(sizes[i] for i in w) <= 2048 for w in packing.windows_for(sizes, 2048))
    assert packing.windows_for([5] * 100, 2048) and packing.difference([], 3) == []


def test_packing(docs, odd, none):
    for df in (docs, odd):
        texts = df.collect()
        rows = packing.pack(df).collect()
        want = sorted((str(r["doc_id"]), crc(encoded(r["text"], 1)), len(encoded(r["text"], 1))) for r in texts)
        parts, windows = {}, {}
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
            parts.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for w in windows.values():
            at = 0
            for offset, length in sorted(w):
                assert offset == at
                at += length
            assert at <= 2048
        if df is docs:
            got = sorted((i, zlib.crc32(b"".join(x for _, x in sorted(p))), n) for (i, n), p in parts.items())
            assert got == want
            total = sum(n for _, _, n in want)
            assert 1 - total / (2048 * len(windows)) < 0.03
        else:
            assert sum(r["length"] for r in rows) == sum(n for _, _, n in want) and len(ROWS) == len(texts)
    assert packing.pack(none).count() == 0
