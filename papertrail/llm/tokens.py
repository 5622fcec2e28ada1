"""Token ids and token counts of whole texts, equal to the tokenizer libraries' own."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import islice

from papertrail.llm.common import kept

#: Words that a Python worker remembers, about 0.2 KB each. At the limit it keeps the quarter it met first, which holds
#: the frequent ones, so that memory stays bounded.
CACHED = 600_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker: the next task goes on with the words of the last."""
    return kept(("words", path), lambda: WordEncoder(path))


def piece_counter(path: str) -> PieceCounter:
    return kept(("pieces", path), lambda: PieceCounter(path))


class WordEncoder:
    """Ids of `word_bpe_49k.json` (tokenizers library, add_special_tokens=False) as little-endian unsigned 32-bit bytes.

    The tokenizer's patterns match no white space, its normaliser composes nothing across it and its added tokens hold
    none, so ASCII white space always ends a token: the ids of a text are those of its words. It lower-cases, so words are
    kept in lower case. Letters and the marks behind them are tokens apart (an apostrophe need not be). Each word goes
    through the library once and is remembered.
    """

    MARKS = ".,;:!?%$#&*|)]}\""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added_head = os.path.commonprefix(added).encode() if added else None
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Iterable[bytes]) -> None:
        import numpy as np

        known, stems, hard, marked = self.known, set(), [], []
        new = list(words)
        for w, s in zip(new, b"\n".join(new).decode("utf-8", "replace").split("\n"), strict=bool(new)):
            if s.isalpha() and (s.isascii() or s.lower().isalpha()):
                stems.add(w)
                continue
            stem = s.rstrip(self.MARKS)
            if len(stem) < len(s) and stem.isalpha() and stem.lower().isalpha():
                marked.append((w, stem.encode(), s[len(stem) :].encode()))
            else:
                hard.append(w)
        hard = list({*hard, *(t for _, _, t in marked)}.difference(known))
        known.update(zip(hard, self._ids([w.decode("utf-8", "replace") for w in hard]), strict=True))
        stems.update(x for _, x, _ in marked if x not in known)
        plain = list(stems)
        for a in range(0, len(plain), 1000):  # a word of letters ends with the only id that has an end mark
            own = plain[a : a + 1000]
            raw = self._ids([b" ".join(own).decode()])[0]
            stops = (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1).tolist()
            known.update(zip(own, (raw[4 * i : 4 * j] for i, j in zip([0, *stops], stops)), strict=True))
        for w, x, t in marked:
            known[w] = known[x] + known[t]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. New words are learned for a thousand texts at once."""
        done: list[bytes] = []
        for at in range(0, len(texts), 1000):
            split = [(t if self.added_head is not None and self.added_head in t else t.lower()).split() for t in texts[at : at + 1000]]  # bytes: A-Z, ASCII white space
            if len(self.known) > CACHED:
                self.known = dict(islice(self.known.items(), CACHED // 4))
            self._learn(set().union(*split).difference(self.known))
            look = self.known.__getitem__
            done += [b"".join(map(look, words)) for words in split]
        return done


class PieceCounter:
    """Token counts of a sentencepiece BPE model, by whole pre-tokens.

    Proved offline, when the model is loaded: no piece of the vocabulary holds a word mark behind another character, and
    none holds a line feed. So no merge ever joins what is left and right of a mark that follows another character, or of
    a line feed: texts may be cut there. `whole` are the vocabulary strings that the library encodes alone as the one
    token they are; pre-tokens among them count 1 directly. Only the rest go through the library's merges, once each.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        if any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces across word ends: its texts can't be cut there")
        if self.library.encode("a  b", out_type=str) != [f"{self.MARK}a", self.MARK, f"{self.MARK}b"]:
            raise ValueError("this model changes white space")
        heads = [p[1:] for p in pieces if p[0] == self.MARK and self.MARK not in p[1:]]
        alone = self.library.encode(heads)
        self.whole = {h: 1 for h, ids in zip(heads, alone, strict=True) if len(ids) == 1}
        self.known = dict(self.whole)
        self.cut = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")

    def _merge(self, pre: str) -> int:
        """pre begins with blanks, with a line feed, or else stands for one blank and itself."""
        if len(self.known) > CACHED + len(self.whole):
            self.known = dict(islice(self.known.items(), len(self.whole) + CACHED // 4))
        if pre[:1] == "\n":
            n = len(self.library.encode(pre)) - 1  # the library's mark in front of a line feed is a token of its own
        elif pre == " ":
            n = 1
        elif pre[:1] == " ":
            n = len(self.library.encode(pre[1:]))  # it puts the first mark itself
        else:
            n = len(self.library.encode(pre)) if pre else 1
        self.known[pre] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.MARK in text:
            text = text.replace(self.MARK, " ")  # the model has the same sign for both
        if text[0] == " " or "  " in text:
            pres = [p[1:] if p[0] == " " and p[1:2] not in (" ", "") else p for p in self.cut.findall(" " + text)]
        else:
            pres = text.replace("\n", " \n").split(" ")
        known = self.known
        total = 0
        try:
            return sum(map(known.__getitem__, pres))
        except KeyError:
            for p in pres:
                n = self.known.get(p)
                total += self._merge(p) if n is None else n
            return total
