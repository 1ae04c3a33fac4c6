"""Token ids of many texts with a public tokenizer file, each distinct word encoded once per worker.

The library encodes a text in parts that its pre-tokenizer cuts at white space and between a letter and a following mark, so the ids of a text are
those of its parts. Parts are found and hashed in numpy, only parts not met before go to the library. Texts in which a cut could fall otherwise
(white space beyond ASCII, strings that look like special tokens) are handed to the library whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from palimpsest.llm.bytescan import SPACE, document_starts, hashes, slices, words

#: Encoded words that one worker keeps; beyond it the store starts anew. About 50 bytes each.
WORDS_KEPT = 400_000

_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
_loaded: dict[str, "Encoder"] = {}

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
#: ASCII marks that end a run of letters; an apostrophe may belong to a contraction.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _byte_letters() -> dict[int, str]:
    """The character that byte-level models write for each byte: itself if printable, otherwise the next free one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file; one per worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Whether white space is part of the ids; otherwise it only separates words.
        self.keeps_space = len(self.library.encode(" \n", add_special_tokens=False).ids) > 0
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.lower = self.library.encode("A", add_special_tokens=False).ids == self.library.encode("a", add_special_tokens=False).ids
        probe = ["The", " naive", " ÉTÉ", "zuß", " reenthtion", "q", "Xqzkj", " ñandú"]
        #: Whether the model alone gives a lone word's ids, without the steps around it.
        self.direct = all(self._of_word(w) == self.library.encode(w, add_special_tokens=False).ids for w in probe)
        self._clear()

    def _of_word(self, word: str) -> list[int]:
        word = word if self.keeps_space else word.strip()
        word = word.lower() if self.lower else word
        return [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def _of_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; runs of Latin letters go straight to the model."""
        if not self.direct:
            return [e.ids for e in self.library.encode_batch(parts, add_special_tokens=False)]
        lone = [(p[1:] if p[:1] == " " else p).isalpha() and max(p) <= "ÿ" for p in parts]
        rest = iter(self.library.encode_batch([p for p, x in zip(parts, lone, strict=True) if not x], add_special_tokens=False))
        return [self._of_word(p) if x else next(rest).ids for p, x in zip(parts, lone, strict=True)]

    def _clear(self) -> None:
        self.keys, self.slots, self.check = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
        self.begin, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after the other, and their number per document."""
        out, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for first, last in slices(at):
            ids, n = self._slice(buf[at[first]:at[last]], at[first:last + 1] - at[first])
            out.append(ids)
            counts.append(n)
        return np.concatenate(out), np.concatenate(counts)

    def _slice(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        odd = np.unique(np.searchsorted(at, [m.start() for m in _ODD.finditer(data)], side="right") - 1)
        start, end, doc = self._marked(buf, *(self._spaced(buf, at) if self.keeps_space else words(buf, at)))
        if len(odd):
            plain = ~np.isin(doc, odd)
            start, end, doc = start[plain], end[plain], doc[plain]
        check = hashes(buf, start, end, lane=1)
        slot = self._slots(data, hashes(buf, start, end), check, start, end)
        # Another word has the hash of this one: its text is encoded as a whole.
        if len(alike := np.unique(doc[self.check[slot] != check])):
            odd = np.union1d(odd, alike)
            plain = ~np.isin(doc, odd)
            slot, doc = slot[plain], doc[plain]
        size = self.size[slot]
        total = int(size.sum())
        where = np.repeat(self.begin[slot] - (np.cumsum(size) - size), size) + np.arange(total)
        ids = self.pool[where]
        counts = np.bincount(doc, weights=size, minlength=len(at) - 1).astype(np.int64)
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for d in odd:
                text = data[at[d]:at[d + 1]].decode("utf-8", "replace")
                parts[d] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
                counts[d] = len(parts[d])
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _marked(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts, cut once more where a mark follows a letter."""
        cut = np.flatnonzero(_LETTER[buf[:-1]] & _MARK[buf[1:]]) + 1
        part = np.searchsorted(start, cut, side="right") - 1
        inside = (part >= 0) & (cut > start[part]) & (cut < end[part]) if len(start) else np.zeros(len(cut), bool)
        cut, part = cut[inside], part[inside]
        if not len(cut):
            return start, end, doc
        order = np.argsort(starts := np.concatenate([start, cut]), kind="stable")
        starts, docs = starts[order], np.concatenate([doc, doc[part]])[order]
        ends = np.concatenate([end, end[part]])[order]
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        return starts, ends, docs

    @staticmethod
    def _spaced(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts that cover the whole text: words with one blank before them, and other white space without the last of its characters."""
        n = len(buf)
        if n == 0:
            e = np.empty(0, np.int64)
            return e, e, e
        space, begins = SPACE[buf], document_starts(at, n)
        before = np.zeros(n, bool)
        before[1:] = space[:-1]
        blank = np.zeros(n, bool)
        blank[1:] = buf[:-1] == 32
        word_next = np.zeros(n, bool)
        word_next[:-1] = ~space[1:] & ~begins[1:]
        cut = begins | (~space & before & ~blank) | (space & ~before) | (space & before & word_next)
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], n), np.searchsorted(at, start, side="right") - 1

    def _slots(self, data: bytes, h: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key, inverse = np.unique(h, return_inverse=True)
        if len(self.keys) + len(key) > WORDS_KEPT:
            self._clear()
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        if not known.all():
            some = np.empty(len(key), np.int64)
            some[inverse] = np.arange(len(h))
            new = np.flatnonzero(~known)
            texts = [data[start[i]:end[i]].decode("utf-8", "replace") for i in some[new]]
            ids = self._of_parts(texts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(size.sum()))
            slots = len(self.begin) + np.arange(len(new))
            self.check = np.concatenate([self.check, check[some[new]]])
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, flat])
            self.keys, self.slots = np.insert(self.keys, at[new], key[new]), np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, key)
        return self.slots[at][inverse]
