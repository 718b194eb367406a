"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of the lower-cased text; a letter of a script that is written without spaces
(Han, Hiragana, Katakana, Thai, Lao, Khmer, Myanmar) is a word of its own.  Seeds are the runs of ``k`` consecutive words that a
document and a benchmark item share, found by a join on Karp-Rabin hashes of k words; a hash is joined once for each document, whatever its
number of places there.  Pairs whose seeds cover enough of the item are tiled: the longest match of unmarked words of both is sought
by hashes of falling length (its length by bisection, for a shorter run of a match is a match), marked, and so on while there is one of k
words or more (ties: least place in the document, then in the item).  A document is contaminated by an item of which
marked words cover at least ``coverage``, whatever their order in the document.

What a task holds is a sum of texts and items, never a product of places: hashes of runs of 1, 2, 4, ... words of those parts of the
document that seeds cover.  Tiles of an item of m words have at most sqrt(2 m) different lengths, so time is at most that many passes.

The items' hashes are sent to every task if they are at most ``bound`` bytes, which is checked; beyond that, seeds come from a
shuffled join on the hash, with the same result.

Nulls: null texts have no words.  Items of fewer than k words never match.  Repeated items and repeated documents are reported
each, whichever way seeds are found.  Ties between tiles of one length go to the least places.  doc_id and item_id may be
null.  Very long texts are worked on whole.  Other columns, of any names, are kept or ignored.  Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import free
from quillspan.llm.words import NOT_ALNUM, Words, mix, slices

# Scripts without spaces between words.
_UNSPACED = "([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]\\p{M}*)"
_TILES = "array<struct<doc_start:int,item_start:int,length:int>>"
RESULT = f"doc_id long, item_id long, item_words int, covered int, coverage double, tiles {_TILES}"


def _plain(text: Column) -> Column:
    """The text in lower case; what lies between words is ASCII in it."""
    low = F.lower(text.cast("string"))
    worded = F.regexp_replace(low, "[^\\p{L}\\p{M}\\p{N}\\x00-\\x7F]+", " ")
    beyond = low.rlike("[^\\x00-\\u0DFF\\u1E00-\\u20FF]")  # scripts written without spaces lie there
    return F.when(beyond, F.regexp_replace(worded, _UNSPACED, " $1 ")).when(low.rlike("[^\\x00-\\x7F]"), worded).otherwise(low)


def _runs(h: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... words, as far as ``longest`` needs them."""
    out, size = [h], 1
    while 2 * size <= longest and len(h) >= 2 * size:
        left, right = out[-1][:-size], out[-1][size:]
        out.append(mix(left * np.uint64(0x9FB21C651E98DF25) ^ ((right << np.uint64(23)) | (right >> np.uint64(41))), size))
        size *= 2
    return out


def _of_length(levels: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words at some places, each of two runs that overlap."""
    j = min(n.bit_length() - 1, len(levels) - 1)
    return levels[j][at] * np.uint64(0xD6E8FEB86659FD93) ^ levels[j][at + n - (1 << j)]


def _free(is_open: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many open words with consecutive places follow each, with itself."""
    n = len(is_open)
    stop = ~is_open
    ends = np.ones(n, bool)
    ends[:-1] = stop[1:] | (np.diff(place) != 1)
    last = np.flatnonzero(ends | stop)
    out = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
    out[stop] = 0
    return out


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (doc word, item word, length) of two arrays of word hashes, longest first."""
    if min(len(doc), len(item)) < k:
        return []
    levels = _runs(item, len(item))
    seeds = np.flatnonzero(np.isin(_of_length(_runs(doc, k), np.arange(len(doc) - k + 1), k), _of_length(levels, np.arange(len(item) - k + 1), k)))
    inside = np.zeros(len(doc) + 1, np.int64)
    np.add.at(inside, seeds, 1)
    np.add.at(inside, seeds + k, -1)
    place = np.flatnonzero(np.cumsum(inside[:-1]))  # the words of the document that seeds cover
    if not len(place):
        return []
    of_doc, doc_levels = np.ones(len(place), bool), _runs(doc[place], len(item))
    of_item, item_place = np.ones(len(item), bool), np.arange(len(item))

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document words, their hashes, item words, their hashes) of the free runs of n words that both have."""
        d, i = np.flatnonzero(doc_free >= n), np.flatnonzero(item_free >= n)
        hd, hi = _of_length(doc_levels, d, n), _of_length(levels, i, n)
        kd, ki = np.isin(hd, hi), np.isin(hi, hd)
        return d[kd], hd[kd], i[ki], hi[ki]

    tiles, most = [], len(item)
    while True:
        doc_free, item_free = _free(of_doc, place), _free(of_item, item_place)
        low, high = k - 1, min(most, int(doc_free.max()), int(item_free.max()))
        probe = high
        while low < high:  # the greatest length with a match, or k - 1
            if len(common(probe)[0]):
                low = probe
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        if low < k:
            return tiles
        n, most = low, low - 1
        d, hd, i, hi = common(n)
        order = np.argsort(hi, kind="stable")
        hi, i = hi[order], i[order]
        first, last = np.searchsorted(hi, hd), np.searchsorted(hi, hd, side="right")
        ahead, left, after = {}, len(np.unique(hi)), -1
        for at, lo, end in zip(d.tolist(), first.tolist(), last.tolist(), strict=True):
            if at < after:
                continue
            now = ahead.get(lo, lo)
            if now == end:
                continue
            while now < end and not (of_item[i[now]] and of_item[i[now] + n - 1]):
                now += 1
            if now < end:
                begin, after = int(i[now]), at + n
                tiles.append((int(place[at]), begin, n))
                of_doc[at : at + n] = of_item[begin : begin + n] = False
                now += 1
            ahead[lo] = now
            if now == end:
                left -= 1
                if not left:
                    break


class _Index:
    """Hashes of the items' runs of k words, sorted, with item and place, and of their words."""

    def __init__(self, ids: list, texts: pa.Array, k: int):
        words = Words(texts, NOT_ALNUM)
        g, at = words.grams(k)
        order = np.argsort(g, kind="stable")
        self.hash, at = g[order], at[order]
        self.item = words.text_of(at)
        self.place = at - words.first[self.item]
        self.size = np.diff(words.first)
        self.words, self.first = words.hash, words.first
        self.ids = ids

    def spans(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of each hash begin, and how many there are."""
        low = np.searchsorted(self.hash, g)
        return low, np.searchsorted(self.hash, g, side="right") - low


def _covered(edge: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """How many words the runs of k words at sorted places cover, of each group that begins at an edge."""
    gap = np.append(np.diff(place), k)
    gap[np.append(edge[1:], len(place)) - 1] = k
    return np.add.reduceat(np.minimum(gap, k), edge)


_MOST = 1 << 22


def _matches(index: _Index, texts: pa.Array, k: int, coverage: float) -> list[tuple]:
    """(row, item_id, words of the item, covered, tiles) of the contaminated rows."""
    words = Words(texts, NOT_ALNUM)
    g, at = words.grams(k)
    low, n = index.spans(g)
    hit = np.flatnonzero(n)
    if not len(hit):
        return []
    row = words.text_of(at[hit])
    order = np.lexsort((low[hit], row))
    hit, row = hit[order], row[order]
    once = np.append(True, (row[1:] != row[:-1]) | (low[hit[1:]] != low[hit[:-1]]))  # a hash counts once a text
    row, low, n = row[once], low[hit[once]], n[hit[once]]
    out = []
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    total, begin = np.append(0, np.cumsum(n)), 0
    while begin < len(row):  # some texts at a time, a text of many seeds alone
        end = int(ends[max(np.searchsorted(ends, begin, side="right"), np.searchsorted(total[ends], total[begin] + _MOST, side="right") - 1)])
        part = slice(begin, end)
        which = np.repeat(row[part], n[part])
        entry = np.repeat(low[part] - total[begin:end] + total[begin], n[part]) + np.arange(len(which))
        item, place = index.item[entry], index.place[entry]
        order = np.lexsort((place, item, which))
        which, item, place = which[order], item[order], place[order]
        edge = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (item[1:] != item[:-1])))
        enough = edge[_covered(edge, place, k) >= coverage * index.size[item[edge]]]  # else all seeds together cover too little
        for r, i in zip(which[enough].tolist(), item[enough].tolist(), strict=True):
            tiles = tile(words.hash[words.first[r] : words.first[r + 1]], index.words[index.first[i] : index.first[i + 1]], k)
            covered = sum(x for *_, x in tiles)
            if covered >= coverage * index.size[i]:
                out.append((r, index.ids[i], int(index.size[i]), covered, tiles))
        begin = end
    return out


def _index(items: DataFrame, k: int, bound: int):
    """The items' index if it is within the bound, else None."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), _plain(F.col("text")).alias("text")).filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > bound:
        return None
    found = items.orderBy("item_id", "text").collect()  # at most ``bound`` bytes
    return _Index([r.item_id for r in found], pa.array([r.text for r in found], pa.string()), k)


def _keyed(docs: DataFrame, kd: str, kh: str) -> DataFrame:
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumn(kd, F.coalesce(id_, F.lit(-(2**63)))).withColumn(kh, F.xxhash64(text))


def _seed_join(docs: DataFrame, items: DataFrame, k: int, coverage: float) -> DataFrame:
    """RESULT with the rows' keys _kd and _kh, a row for each row of docs and time that the item comes.  The hashes that a document and an
    item share are joined, each once a document; adaptive execution splits a hash that many documents have.  Pairs whose
    seeds cover enough are joined with their texts and tiled."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                words = Words(part.column(part.num_columns - 1), NOT_ALNUM)
                g, at = words.grams(k)
                row = words.text_of(at)
                if "_ki" not in batch.schema.names:
                    order = np.lexsort((g, row))
                    keep = order[np.append(True, (np.diff(row[order]) != 0) | (g[order][1:] != g[order][:-1]))[: len(order)]]
                    g, at, row = g[keep], at[keep], row[keep]
                cols = [part.column(i).take(pa.array(row)) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(g.view(np.int64)), pa.array(at - words.first[row]), pa.array(np.diff(words.first)[row])], [*batch.schema.names[:-1], "g", "place", "size"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles", "_kd", "_kh"]
        for batch in batches:
            for part in slices(batch, 4):
                doc, item = Words(part.column(4), NOT_ALNUM), Words(part.column(5), NOT_ALNUM)
                cols = [[] for _ in names]
                for r in range(part.num_rows):
                    size = int(item.first[r + 1] - item.first[r])
                    found = tile(doc.hash[doc.first[r] : doc.first[r + 1]], item.hash[item.first[r] : item.first[r + 1]], k)
                    covered = sum(n for *_, n in found)
                    if covered >= coverage * size:
                        value = (part.column(2)[r].as_py(), part.column(3)[r].as_py(), size, covered, covered / size, [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in found], *(part.column(i)[r].as_py() for i in range(2)))
                        for col, x in zip(cols, value, strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _types(), strict=True)], names)

    text = _plain(F.col("text")).alias("text")
    rows = _keyed(docs.select("doc_id", "text"), "_kd", "_kh").select("_kd", "_kh", F.col("doc_id").cast("long").alias("doc_id"), text)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("times"))
    items = items.withColumn("_ki", F.xxhash64("item_id", "text"))
    left = rows.select("_kd", "_kh", "text").mapInArrow(grams, "_kd long, _kh long, g long, place long, size long").select("_kd", "_kh", "g")
    right = items.select("_ki", text).mapInArrow(grams, "_ki long, g long, place long, size long")
    places = F.array_sort(F.collect_set("place")).alias("places")  # at most the item's
    steps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.coalesce(F.least(y - x, F.lit(k)), F.lit(k)).cast("long"))
    seeds = left.join(right, "g").groupBy("_kd", "_kh", "_ki").agg(places, F.max("size").alias("size"))
    pairs = seeds.filter(F.aggregate(steps(F.col("places")), F.lit(0).cast("long"), lambda a, x: a + x) >= coverage * F.col("size")).select("_kd", "_kh", "_ki")
    both = pairs.join(rows, ["_kd", "_kh"]).withColumnRenamed("text", "t").join(items.select("_ki", "item_id", text.alias("x"), "times"), "_ki")
    each = both.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("_kd", "_kh", "doc_id", "item_id", "t", "x").mapInArrow(tiles, f"{RESULT}, _kd long, _kh long")


def _types() -> list[pa.DataType]:
    tiles = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
    return [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), tiles, pa.int64(), pa.int64()]


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, coverage: float = 0.5, bound: int = 16 << 20) -> DataFrame:
    """One row for each document and item that cover each other so: see RESULT."""
    index = _index(items, k, bound)
    if index is None:
        return _seed_join(docs, items, k, coverage).drop("_kd", "_kh")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = _matches(sent.value, part.column(1), k, coverage)
                ids = part.column(0).to_pylist()
                rows = [(ids[r], i, n, c, c / n, [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in ts]) for r, i, n, c, ts in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(_types()[:6])], ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(F.col("text")).alias("text")).mapInArrow(work, RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, coverage: float = 0.5, bound: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates.  With a small benchmark nothing is shuffled."""
    index = _index(items, k, bound)
    if index is None:
        kd, kh = free(docs, "kd"), free(docs, "kh")
        bad = _seed_join(docs, items, k, coverage).select(F.col("_kd").alias(kd), F.col("_kh").alias(kh)).distinct()
        return _keyed(docs, kd, kh).join(bad, [kd, kh], "left_anti").drop(kd, kh)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in _matches(sent.value, part.column(at), k, coverage)]] = False
                yield pa.RecordBatch.from_arrays(part.columns[:at], schema=pa.schema(list(part.schema)[:at])).filter(pa.array(keep))

    names = [f"c{i}" for i in range(at)]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], _plain(F.col("text")).alias("t"))
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    return plain.mapInArrow(work, schema).toDF(*docs.columns)
