"""Words of whole texts as arrays: places and 64-bit hashes, computed on the UTF-8 bytes of Arrow columns.

A word is a run of bytes other than space and 0x09-0x0D; both are ASCII, so this equals the same rule on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20
#: Bytes of a word that are hashed at a time.
_LONG = 1 << 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no ASCII letter or digit and not part of a longer code point.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: An odd multiplier for each place in a word: multilinear hashing.  (Powers of one number would collide modulo 2**64.)
_PLACE = mix(np.arange(_LONG, dtype=np.uint64), 3) | np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more entry than texts); nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a column of texts: ``start`` and ``end`` bytes, ``hash``, and ``first``, the first word of each text."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACE):
        data, self.offsets = text_bytes(texts)
        self.data = data
        n = len(data)
        self._separators = separators
        space = separators[data]
        begin = np.zeros(n + 1, bool)
        begin[self.offsets] = True
        start = ~space
        start[1:] &= space[:-1] | begin[1:-1]
        end = ~space
        end[:-1] &= space[1:] | begin[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        low = 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + _BLOCK)))
            out[low:high] = self._block(data, self.start[low:high], self.end[low:high])
            low = high
        return out

    @staticmethod
    def _block(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.empty(len(size), np.uint64)
        short = size <= _LONG
        if short.any():
            out[short] = Words._parts(data, start[short], end[short])
        for i in np.flatnonzero(~short).tolist():  # a long word's parts are mixed with their number and summed
            total = 0
            for low in range(start[i], end[i], 256 * _LONG):
                at = np.arange(low, min(low + 256 * _LONG, end[i]), _LONG)
                h = Words._parts(data, at, np.minimum(at + _LONG, end[i]))
                total += int(mix(h ^ mix((at - start[i]).astype(np.uint64), 5), 6).sum(dtype=np.uint64))
            out[i] = mix(np.array([total % 2**64], np.uint64) ^ np.uint64(size[i]), 4)[0]
        return out

    @staticmethod
    def _parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        origin, at = start[0], start - start[0]
        block = data[origin : end[-1]]
        place = np.arange(len(block)) - np.repeat(at, np.diff(np.append(at, len(block))))
        inside = place < np.repeat(end - start, np.diff(np.append(at, len(block))))
        place[~inside] = 0
        value = np.where(inside, block.astype(np.uint64) + np.uint64(1), 0) * _PLACE[place]
        return mix(np.add.reduceat(value, at) ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words that lie in one text, and the word at which each starts.  Runs of 2, 4, 8, ...
        words are mixed from their halves, and k words from two runs that overlap."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, size = mix(self.hash, seed) if seed else self.hash, 1
        while size < k:
            step = min(size, k - size)
            left, right = h[: len(h) - step], h[step:]
            h = mix(left * np.uint64(0x9FB21C651E98DF25) ^ ((right << np.uint64(23)) | (right >> np.uint64(41))), step)
            size += step
        at = np.arange(n - k + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = at[text[: n - k + 1] == text[k - 1 :]]
        return h[at], at

    def exact(self) -> np.ndarray:
        """A number for each word; words have the same one if and only if their bytes are equal."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.end - self.start
        like = first[number]
        other = size != size[like]
        for low in range(0, len(size), 1 << 16):
            high = min(low + (1 << 16), len(size))
            n = np.where(other[low:high], 0, size[low:high])
            owner = np.repeat(np.arange(low, high), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            bad = self.data[self.start[owner] + place] != self.data[self.start[like[owner]] + place]
            other[owner[bad]] = True
        if other.any():  # words of one hash that differ
            raw, known = self.data.tobytes(), {}
            for i in np.flatnonzero(other).tolist():
                number[i] = known.setdefault(raw[self.start[i] : self.end[i]], len(first) + len(known))
        return number

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The text that holds each word."""
        return np.searchsorted(self.first, word, side="right") - 1


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text (a longer text stands alone)."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1]
    base, low = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset], 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(low, high - low)
        base, low = ends[high - 1], high


def groups(batches: Iterator[pa.RecordBatch], n_keys: int, least: int = 4_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by their first ``n_keys`` columns: tables of complete groups, and where
    each group begins in the table (with its length at the end).  The last group waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows + 1, bool)
        change[[0, -1]] = True
        for i in range(n_keys):
            key = table.column(i).to_numpy()
            change[1:-1] |= key[1:] != key[:-1]
        return np.flatnonzero(change)

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            at = bounds(table)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
                held = table.slice(at[-2]).to_batches()
            else:
                held = table.to_batches()
            rows = sum(x.num_rows for x in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)
