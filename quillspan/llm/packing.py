"""Sum-of-squares online packing of token sequences.

Every document is its ids and an end id.  Windows of ``size`` ids are cut off its front; what is left (fewer than
``size`` ids) is placed whole, at once, in the order of arrival.  Open windows are told apart by their fill level, the
fill by ``unit`` ids.  Of all levels whose latest window has room, and of a new window, the item takes the one after which the
sum over levels of (open windows at that level)**2 is least.  The number of open windows by level is one array, so
placing is one pass over at most ``size / unit`` levels, whatever has arrived before.  A window is closed when fewer than
``unit`` ids are free, so it pads less than ``unit``; ``unit`` 1 is the plain rule.

At the end of a task the windows still open are taken from the same level array: the fullest keep what the rule put there
and are filled up from the emptiest, cutting only to fill, so each task pads one more sequence at most.  ``closed`` says how
a sequence came about: ``front`` (cut off a long document), ``rule``, ``filled`` (opened by the rule, filled at the end) or
``rest`` (the last one).  Sequences are padded to ``size`` unless their length is a power of two.

Each task packs its own rows, so nothing is shuffled; sequence ids carry the task's number in the upper bits.  A
repeated task packs the same rows again.  Memory: the open windows' ids, whose number
by level the rule keeps small.

Nulls: a null text packs its end id alone.  Repeated rows are packed as often as they come.  Ties between levels go to
the fullest; documents of any length are taken, a batch of 128 at a time.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.token_ids import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long, closed string"
_TASK = 1 << 40


class SumOfSquares:
    """Places items of 1 .. size - 1 ids; ``place`` returns the closed window, if the item closed one."""

    def __init__(self, size: int, unit: int = 1):
        self.size, self.unit = size, unit
        levels = size // unit + 1
        self.count = np.zeros(levels, np.int64)  # open windows by level; a new window counts nowhere
        self.fill = np.full(levels, size)  # ids in the latest window of each level
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(levels)]

    def level(self, length: int) -> int:
        """The level to place at, -1 for a new window.  Moving one window from h to g changes the sum of squares by
        2 (n[g] - n[h]) + 2, without the first term if the window is closed and without the second if it is new."""
        n, after = self.count, self.fill + length
        fits = np.flatnonzero((n > 0) & (after <= self.size))
        after = after[fits]
        to = after // self.unit
        gain = np.where(self.size - after < self.unit, 0, 2 * n[to] + 1)
        change = np.where((to == fits) & (gain > 0), 0, gain - 2 * n[fits] + 1)
        alone = 0 if self.size - length < self.unit else 2 * int(n[length // self.unit]) + 1
        if not len(fits) or alone < change.min():
            return -1
        return int(fits[len(fits) - 1 - np.argmin(change[::-1])])

    def place(self, item, length: int) -> list | None:
        at = self.level(length)
        fill, window = 0, []
        if at >= 0:
            fill, window = self.open[at].pop()
            self.count[at] -= 1
            self.fill[at] = self.open[at][-1][0] if self.open[at] else self.size
        window.append((item, length))
        fill += length
        if self.size - fill < self.unit:
            return window
        to = fill // self.unit
        self.open[to].append((fill, window))
        self.count[to] += 1
        self.fill[to] = fill
        return None

    def rest(self) -> list[tuple[int, list]]:
        """(fill, window) of those still open, fullest first."""
        out = sorted((w for level in self.open for w in level), key=lambda w: -w[0])
        self.__init__(self.size, self.unit)
        return out


def filled(rest: list[tuple[int, list]], size: int) -> Iterator[list]:
    """Windows of items (doc, start, ids, tokens): the fullest, each filled up with ids cut off items of the emptiest."""
    low, high = 0, len(rest) - 1
    while low <= high:
        fill, window = rest[low]
        while fill < size and high > low:
            items = rest[high][1]
            if not items:
                high -= 1
                continue
            (doc, at, ids, whole), length = items.pop()
            take = min(size - fill, length)
            window.append(((doc, at, ids[:take], whole), take))
            fill += take
            if take < length:
                items.append(((doc, at + take, ids[take:], whole), length - take))
        low += 1
        if window:
            yield window


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, unit: int = 16) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most ``size`` ids; ``ids`` are little-endian uint32."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"ids": pa.binary(), "closed": pa.string()}.get(n, pa.int64()) for n in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer, next_id = SumOfSquares(size, unit), TaskContext.get().partitionId() * _TASK
        rows: list[list] = []

        def close(window: list, how: str) -> None:
            nonlocal next_id
            total = sum(length for _, length in window)
            padded = total if total & (total - 1) == 0 else size
            offset = 0
            for (doc, start, ids, whole), length in window:
                rows.append([doc, start, length, ids.tobytes(), whole, next_id, offset, padded, how])
                offset += length
            next_id += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids)
                    for at in range(0, whole - size + 1, size):
                        close([((doc, at, ids[at : at + size], whole), size)], "front")
                    if left := whole % size:
                        at = whole - left
                        if done := packer.place((doc, at, ids[at:], whole), left):
                            close(done, "rule")
                if rows:
                    yield out()
        for window in filled(packer.rest(), size):
            close(window, "filled" if sum(n for _, n in window) == size else "rest")
            if len(rows) >= 4096:
                yield out()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
