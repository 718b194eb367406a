"""Fill-in-middle: texts cut into prefix, middle and suffix and written anew with marks, and their way back.

One numpy kernel works on the UTF-8 buffer of a run of rows.  A table gives each byte its class (inside a code point, space,
line end, other); a mask over adjacent classes says where a unit begins (``char``: a code point, ``word``: a word with the spaces
after it, ``line``: a line with its end); the running sum of the mask, less its value where a text begins, numbers
the units of each text; and one binary search in that sum finds the cut bytes of all rows.

Numbers h1 to h4 are the first four 8-digit groups of the hex sha256 of ``<seed>:<doc_id>``.  A text of n units is cut after
h1 % (n + 1) and h2 % (n + 1) units, the smaller first.  ``plain`` texts stay as they are: empty ones, those that contain a mark, and
those with h3 % 100 >= ``rate``.  Others are ``spm`` if h4 % 100 < ``spm``, else ``psm``.

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

``restore`` reads a text back from output and form alone: no text that is cut contains a mark, and a mark's first character
occurs nowhere else in marks, so the first mark of each kind is the written one.

Nulls: a null text is empty; a null doc_id has no digits (``<seed>:``).  Repeated rows are cut alike.  Rows are worked on in runs of about half a
megabyte, a longer text alone (about ten bytes of memory for each of its bytes).  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import slices, text_bytes

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_INSIDE, _SPACE, _END, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _INSIDE
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _END


def _begins(unit: str) -> np.ndarray:
    """Whether a unit begins at a byte, by the classes of the byte before it and its own."""
    table = np.zeros((4, 4), bool)
    if unit == "char":
        table[:, [_SPACE, _END, _OTHER]] = True
    elif unit == "word":
        table[[_SPACE, _END], _OTHER] = True
    elif unit == "line":
        table[_END, :] = True
    else:
        raise ValueError(f"no such unit: {unit}")
    return table


def _checked(marks: tuple[str, ...]) -> list[bytes]:
    if len(marks) != 3 or any(not m or not m.isascii() for m in marks) or len({m[0] for m in marks}) != 1:
        raise ValueError("three ASCII marks with the same first character")
    if any(m[0] in m[1:] for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks) or len(set(marks)) != 3:
        raise ValueError("a mark's first character must not come again in it, and no mark may begin another")
    return [m.encode() for m in marks]


class _Texts:
    """A column of texts as bytes; ``find`` gives the places of marks, ``gather`` new texts made of pieces."""

    def __init__(self, texts: pa.Array, marks: list[bytes]):
        self.data, self.offsets = text_bytes(texts)
        self.marks = marks
        self.small = np.int32 if len(self.data) + sum(map(len, marks)) < 2**31 else np.int64

    def find(self, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of each occurrence that lies in one text."""
        at = np.flatnonzero(self.data[: max(0, len(self.data) - len(mark) + 1)] == mark[0])
        for i, b in enumerate(mark[1:], 1):
            at = at[self.data[at + i] == b]
        text = np.searchsorted(self.offsets, at, side="right") - 1
        inside = at + len(mark) <= self.offsets[text + 1]
        return text[inside], at[inside]

    def gather(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """A text for each row of (pieces a row); places from the end of the data on are those of the marks."""
        source = np.concatenate([self.data, np.frombuffer(b"".join(self.marks), np.uint8)])
        flat, size = starts.ravel(), sizes.ravel()
        ends = np.cumsum(size)
        place = np.repeat((flat - (ends - size)).astype(self.small), size)
        place += np.arange(len(place), dtype=self.small)
        offsets = np.append(0, ends[sizes.shape[1] - 1 :: sizes.shape[1]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(source[place])).cast(pa.string())

    def mark_places(self) -> np.ndarray:
        return len(self.data) + np.cumsum([0, *(len(m) for m in self.marks[:-1])])


def _cut(texts: pa.Array, h: list[np.ndarray], begins: np.ndarray, rate: int, spm: int, marks: list[bytes]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a run of texts, all at once."""
    t = _Texts(texts, marks)
    low, high = t.offsets[:-1], t.offsets[1:]
    kind = _CLASS[t.data]
    begin = np.zeros(len(kind), bool)
    begin[1:] = begins[kind[:-1], kind[1:]]
    begin[low[low < high]] = True
    units = np.zeros(len(kind) + 1, t.small)  # units that begin before each byte
    np.cumsum(begin, out=units[1:])
    n = (units[high] - units[low]).astype(np.int64)
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    byte = np.searchsorted(units[1:], (units[low] + cuts + 1).astype(t.small))  # the unit that begins after the cut
    byte = np.where(cuts == n, high, byte)
    marked = np.zeros(len(low), bool)
    for m in marks:
        marked[t.find(m)[0]] = True
    plain = (low == high) | marked | (h[2] % 100 >= rate)
    swapped = ~plain & (h[3] % 100 < spm)
    chars = np.zeros(len(kind) + 1, t.small)
    np.cumsum(kind != _INSIDE, out=chars[1:])
    places, lengths = t.mark_places(), np.array([len(m) for m in marks])
    prefix, middle, suffix = (low, byte[0]), (byte[0], byte[1]), (byte[1], high)
    order = lambda a, b: np.where(swapped, a, b)
    starts = np.stack([order(places[1], places[0]), order(suffix[0], prefix[0]), order(places[0], places[1]), order(prefix[0], suffix[0]), np.full(len(low), places[2]), middle[0]], axis=1)
    ends = np.stack([order(suffix[1], prefix[1]), order(prefix[1], suffix[1]), middle[1]], axis=1)
    sizes = np.empty_like(starts)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = order(lengths[1], lengths[0]), order(lengths[0], lengths[1]), lengths[2]
    sizes[:, 1::2] = ends - starts[:, 1::2]
    starts[plain, 1], sizes[plain] = low[plain], 0
    sizes[plain, 1] = (high - low)[plain]
    form = pa.array(np.where(plain, "plain", np.where(swapped, "spm", "psm")), pa.string())
    count = lambda a, b: pa.array((chars[b] - chars[a]).astype(np.int64), mask=plain)
    return [pa.array(n), form, count(*prefix), count(*middle), t.gather(starts, sizes)]


def _joined(output: pa.Array, form: np.ndarray, marks: list[bytes]) -> pa.Array:
    """The texts that outputs were made of."""
    t = _Texts(output, marks)
    low, high = t.offsets[:-1], t.offsets[1:]
    at = np.zeros((3, len(low)), np.int64)
    for i, m in enumerate(marks):
        text, place = t.find(m)
        first = np.append(True, text[1:] != text[:-1])[: len(text)]
        at[i, text[first]] = place[first]
    psm, spm = form == "psm", form == "spm"
    (p, s, m), (np_, ns, nm) = at, (len(x) for x in marks)
    starts = np.stack([p + np_, m + nm, s + ns], axis=1)
    ends = np.stack([np.where(psm, s, m), high, np.where(psm, m, p)], axis=1)
    plain = ~psm & ~spm
    starts[plain], ends[plain] = 0, 0
    starts[plain, 0], ends[plain, 0] = low[plain], high[plain]
    return t.gather(starts, ends - starts)


def transform(docs: DataFrame, unit: str = "char", rate: int = 90, spm: int = 20, seed: str = "1", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """SCHEMA of docs(doc_id, text): ``output`` and how it came about; no shuffle.  ``n`` counts units."""
    begins, raw = _begins(unit), _checked(marks)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                h = [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays([part.column(0), *_cut(part.column(1), h, begins, rate, spm, raw)], names)

    id_ = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("_digest"))
    return rows.select("doc_id", "text", *numbers).mapInArrow(work, SCHEMA)


def restore(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of a transformed table with one more column, ``restored``: the text rebuilt from output and form."""
    raw = _checked(marks)
    rest = [c for c in cut.columns if c != "output"]
    at = len(rest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                form = part.column(rest.index("form")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column(at), form, raw)], [*rest, "output", "restored"])

    types = dict(cut.dtypes)
    return cut.select(*rest, "output").mapInArrow(work, ", ".join(f"`{c}` {types[c]}" for c in [*rest, "output"]) + ", restored string")
