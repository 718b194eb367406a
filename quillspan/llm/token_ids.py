"""Token ids of whole texts, made by the ``tokenizers`` library.

A byte-level BPE never merges across its pre-tokens.  So texts are cut at pre-token borders with array
arithmetic, every *distinct* piece goes through the library once, and its ids are kept in a bounded table; the
ids of a text are the table's entries end to end.  Pieces are found by a hash of their code points and compared by
the code points themselves; pieces of more than ``SHORT`` are neither kept nor shared.

Borders are found by classes of code points (letter, number, space, other).  Words with an apostrophe stay whole,
for there the library's pattern knows contractions; texts with a code point from ``FAST`` on, and tokenizers of
another kind than byte-level with the usual pattern, go through the library as they are.  So do texts that hold one of the
tokenizer's added tokens, which the library finds before it cuts: they get that token's id, as with the library's defaults.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

from quillspan.llm.words import mix

FAST = 0x2E80
SHORT = 64
# The code points below FAST with the Unicode property White_Space.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
_LETTER, _NUMBER, _SPACE, _OTHER, _BORDER = range(5)
_END = "￿"
#: An odd multiplier for each place in a piece.
_PLACE = mix(np.arange(SHORT, dtype=np.uint64), 21) | np.uint64(1)


def _classes() -> np.ndarray:
    kind = np.full(0x10000, _OTHER, np.uint8)
    for c in range(FAST):
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kind[_SPACES] = _SPACE
    kind[ord(_END)] = _BORDER
    return kind


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256 on."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shows} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shows)}


def _ahead(size: np.ndarray) -> np.ndarray:
    """Where each of several runs begins when they are laid end to end."""
    return np.cumsum(size) - size


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    ``memo`` bounds the number of distinct pieces kept, and 16 times as many code points of theirs (the table is emptied
    when full).  ``chunk`` bounds the code points worked on at a time.
    """

    def __init__(self, path: str, memo: int = 1_000_000, chunk: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self._t = Tokenizer.from_file(path)
        self._added = [x["content"] for x in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self._fast = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self._model = self._t.model  # for pieces that are one pre-token
        self._letters = _byte_letters()
        self._kind, self._limit, self._chunk = _classes(), memo, chunk
        self._bits = max(10, (2 * memo - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._at = np.zeros(1 << self._bits, np.int64)
        self._len = np.zeros(1 << self._bits, np.int64)
        self._pool, self._used, self._n = np.zeros(1 << 20, np.uint32), 0, 0
        self._letter_at, self._size = np.zeros(1 << self._bits, np.int32), np.zeros(1 << self._bits, np.uint8)
        self._text, self._text_used = np.zeros(1 << 20, np.uint32), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 2048):
            out += [e.ids for e in self._t.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
        return out

    def _tokens(self, pieces: list[str]) -> list[list[int]]:
        """Of pieces that are one pre-token each."""
        tokenize, letters = self._model.tokenize, self._letters
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot that holds each hash, or -1."""
        mask = np.int64((1 << self._bits) - 1)
        slot = (h >> np.uint64(64 - self._bits)).astype(np.int64)
        there = self._keys[slot]
        out = np.where(there == h, slot, -1)
        open_ = np.flatnonzero((there != h) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            there = self._keys[slot[open_]]
            hit = there == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there != 0)]
        return out

    def _keep(self, h: np.ndarray, ids: list[list[int]], letters: np.ndarray, sizes: np.ndarray) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        total = int(size.sum())
        while self._used + total > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while self._text_used + len(letters) > len(self._text):
            self._text = np.concatenate([self._text, np.zeros_like(self._text)])
        self._pool[self._used : self._used + total] = [x for one in ids for x in one]
        self._text[self._text_used : self._text_used + len(letters)] = letters
        at, letter_at = self._used + _ahead(size), self._text_used + _ahead(sizes)
        mask = np.int64((1 << self._bits) - 1)
        slot = (h >> np.uint64(64 - self._bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self._keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            to = slot[free]
            self._keys[to], self._at[to], self._len[to] = h[free], at[free], size[free]
            self._letter_at[to], self._size[to] = letter_at[free], sizes[free]
            left = left[self._keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & mask
        self._used += total
        self._text_used += len(letters)
        self._n += len(ids)

    def _joined(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each end with _END, and where each one's ids end."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        k = self._kind[c]
        space, prev, border = k == _SPACE, np.empty_like(k), k == _BORDER
        prev[0], prev[1:] = _BORDER, k[:-1]
        start = k != prev
        after_space = np.zeros(len(c), bool)
        after_space[1:] = (c[:-1] == 32) & ~space[1:] & ~border[1:]
        start &= ~after_space  # the space goes with what follows
        last = np.zeros(len(c), bool)
        last[:-1] = space[:-1] & ~space[1:] & ~border[1:]
        start |= last | border  # of a run of spaces, the last one before a text stands apart
        single = None
        if (quote := np.flatnonzero(c == 39)).size:  # words with an apostrophe stay whole
            word = last | (space & (prev != _SPACE)) | border | ((prev == _SPACE) & ~after_space) | (prev == _BORDER)
            word &= start
            number = np.cumsum(word)
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[quote]] = True
            start &= word | ~whole[number]
            single = whole
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(c))
        size = ends - at
        owner = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(c)) - at[owner]
        place[place >= SHORT] = 0
        h = mix(np.add.reduceat((c.astype(np.uint64) + np.uint64(1)) * _PLACE[place], at) ^ (size.astype(np.uint64) << np.uint64(48)))
        h[h == 0] = 1
        stop, short = border[at], size <= SHORT
        slot = self._slots(h)
        known = (slot >= 0) & short & ~stop & (self._size[slot] == size)
        other = (self._text[np.where(known, self._letter_at[slot], 0)[owner] + place] != c) & known[owner]
        known[owner[other]] = False
        length, where = np.where(known, self._len[slot], 0), self._at[slot]
        missing = np.flatnonzero(~known & ~stop)
        pool = self._pool
        if missing.size:
            some = missing[short[missing]]
            new, first, again = np.unique(h[some], return_index=True, return_inverse=True)
            if self._n + len(new) > self._limit or self._text_used + int(size[some[first]].sum()) > 16 * self._limit:
                self._clear()
                return self._joined(text) if len(new) * 4 < self._limit else self._plain(text)
            like = np.arange(len(at))
            like[some] = some[first[again]]  # pieces of one hash share ids if they are equal
            n = np.where(size[some] == size[like[some]], size[some], 0)
            of = np.repeat(some, n)
            step = np.arange(len(of)) - np.repeat(_ahead(n), n)
            like[some[n == 0]] = some[n == 0]
            unlike = of[c[at[of] + step] != c[at[like[of]] + step]]
            like[unlike] = unlike
            work = np.flatnonzero((like == np.arange(len(at))) & ~known & ~stop)
            one = np.ones(len(work), bool) if single is None else ~single[number[at[work]]]
            ids: list = [None] * len(work)
            for way in (self._tokens, self._library):
                mine = np.flatnonzero(one == (way == self._tokens))
                for j, x in zip(mine.tolist(), way([text[i:e] for i, e in zip(at[work[mine]].tolist(), ends[work[mine]].tolist(), strict=True)]), strict=True):
                    ids[j] = x
            many = np.array([len(x) for x in ids], np.int64)
            pool = np.concatenate([self._pool[: self._used], np.array([x for one in ids for x in one], np.uint32)])
            row = np.searchsorted(work, like[missing])
            where[missing], length[missing] = (self._used + _ahead(many))[row], many[row]
            keep = np.flatnonzero(np.isin(work, some[first]) & (slot[work] < 0))
            kept = work[keep]
            letters = c[np.repeat(at[kept], size[kept]) + np.arange(size[kept].sum()) - np.repeat(_ahead(size[kept]), size[kept])]
            self._keep(h[kept], [ids[j] for j in keep.tolist()], letters, size[kept])
        total = np.cumsum(length)
        out = pool[np.repeat(where - total + length, length) + np.arange(total[-1])]
        return out, total[np.flatnonzero(stop)]

    def _plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self._library(text.split(_END)[:-1])
        return np.array([x for one in ids for x in one], np.uint32), np.cumsum([len(x) for x in ids])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The uint32 ids of each whole text; a null or empty text has none."""
        none = np.zeros(0, np.uint32)
        out: list[np.ndarray] = [none] * len(texts)
        group: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                ids, ends = self._joined("".join(texts[i] + _END for i in group))
                at = 0
                for i, e in zip(group, ends.tolist(), strict=True):
                    out[i], at = ids[at:e], e
            group, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._fast or len(text) > 8 * self._chunk or not text.isascii() and ord(max(text)) >= FAST or any(x in text for x in self._added):
                out[i] = np.array(self._library([text])[0], np.uint32)
                continue
            if size + len(text) > self._chunk:
                flush()
            group.append(i)
            size += len(text) + 1
        flush()
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its table outlives a task."""
    return Encoder(path)
