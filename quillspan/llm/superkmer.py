"""Substring dedup by super-k-mer partitioning: words covered by a repeated window of ``width`` words are removed.

A window's minimiser is the least hash of its runs of ``seed`` words, leftmost on ties.  Consecutive windows with the
same minimiser form a super-k-mer, one string of ``width + windows - 1`` words.  Equal windows have equal minimisers,
so they meet in one bucket, and a window in a bucket that only one super-k-mer enters cannot repeat.  Hence:

1. Count super-k-mers by minimiser over all texts (a partial sum in every task).
2. Each text with a minimiser seen twice or more packs those super-k-mers as strings, sent to the minimiser's bucket.  The
   bucket of a minimiser with more than ``part`` super-k-mers is dealt into parts by the hash of the row.
3. A part sorts the windows of its strings by hash and counts neighbours of one hash whose words are equal, compared as words.
4. Of a minimiser with several parts, each part sends on *one* occurrence of each of its distinct windows (128 bits of a
   cryptographic digest of the window, and where it stands), many to a row, to a bin that the digest names.  A bin sorts
   them: a window from two parts is repeated, also where it was alone in its part.
5. Repeated windows go back to their text as ranges; covered words are removed.

So a passage that a third of all texts share is one window a part in step 4, no task gets a whole group, and the result does
not depend on ``part``.  Memory: the strings of a part, the records of a bin (all records by the number of shuffle partitions).
The joins on a minimiser have one row for it on the other side, so adaptive execution can split them.

Texts are shuffled once, by row key, for both 2 and 5.  A row's key is (doc_id, hash of doc_id and text), so rows with one
doc_id but other texts stay apart, and equal rows count as separate occurrences.

Nulls: a null text has no words; a null doc_id is kept.  Texts of fewer than ``width`` words lose nothing.
Repeated rows remove each other.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import Words, groups, mix, slices

RESULT = "doc_id long, n_words long, n_removed long, kept string"
_RECORD = np.dtype([("one", "<u8"), ("two", "<u8"), ("kd", "<i8"), ("k", "<i8"), ("place", "<i8")])
_FLUSH = 1 << 15


def super_kmers(words: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash (int64), first window and number of windows of every super-k-mer, in order."""
    g, at = words.grams(seed)
    span = width - seed + 1
    if not len(g):
        return np.zeros(0, np.int64), at, at
    text = words.text_of(at)
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), at[:0], at[:0]
    best, size = np.arange(len(g)), 1
    while size < span:  # doubling: the leftmost least of [i, i + size)
        step = min(size, span - size)
        left, right = best[:-step], best[step:]
        best = np.where(g[right] < g[left], right, left)
        size += step
    keep = text[:n] == text[span - 1 :]
    where, best = at[:n][keep], best[keep]
    if not len(where):
        return np.zeros(0, np.int64), where, where
    new = np.ones(len(where), bool)
    new[1:] = (best[1:] != best[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(new)
    return g[best[first]].view(np.int64), where[first], np.diff(np.append(first, len(where)))


def _runs(flag: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and length of the runs of flagged consecutive places of one owner."""
    i = np.flatnonzero(flag)
    if not len(i):
        return i, i, i
    new = np.ones(len(i), bool)
    new[1:] = (owner[i[1:]] != owner[i[:-1]]) | (place[i[1:]] != place[i[:-1]] + 1)
    first = np.flatnonzero(new)
    return owner[i[first]], place[i[first]], np.diff(np.append(first, len(i)))


def _clusters(words: Words, hashes: np.ndarray, where: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones of one bucket are neighbours, and whether each is equal to the one
    before it.  Windows of one hash are compared by their words."""
    order = np.lexsort((hashes, of))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    number = words.exact()

    def equal() -> np.ndarray:
        out = same.copy()
        for low in range(0, len(order), 1 << 14):
            at = np.flatnonzero(same[low : low + (1 << 14)]) + low
            for i in range(width):
                out[at] &= number[where[order[at]] + i] == number[where[order[at - 1]] + i]
        return out

    if not np.array_equal(alike := equal(), same):  # other windows of one hash: sort those by their words too
        run = np.cumsum(~same)
        for r in np.unique(run[same & ~alike]).tolist():
            low, high = np.searchsorted(run, [r, r + 1])
            part = order[low:high]
            order[low:high] = part[np.lexsort(number[where[part][:, None] + np.arange(width)].T)]
        alike = equal()
    return order, alike


def remove_repeats(docs: DataFrame, width: int = 35, seed: int = 8, part: int = 2000) -> DataFrame:
    """One row for each row of docs(doc_id, text): its words, those removed, and the kept words joined by a space."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = 16 * partitions  # a task holds one bin at a time: a sixteenth of a shuffle partition

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 2):
                words = Words(rows.column(2))
                m, at, _ = super_kmers(words, width, seed)
                text = words.text_of(at)
                order = np.lexsort((m, text))
                m, text = m[order], text[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), pa.array(m[first]), pa.array(np.diff(np.append(first, len(m))))], ["kd", "k", "m", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The listed super-k-mers as packed strings."""
        names = ["m", "salt", "parts", "s", "kd", "k", "place"]
        for batch in batches:
            for rows in slices(batch, 2):
                words = Words(rows.column(2))
                m, at, n = super_kmers(words, width, seed)
                text = words.text_of(at)
                lists = rows.column(3)
                listed, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
                pair = np.stack([np.repeat(np.arange(rows.num_rows), size), listed.field("m").to_numpy()])
                order = np.lexsort((pair[1], pair[0]))
                pair, parts = pair[:, order], listed.field("parts").to_numpy()[order]
                # place of (text, m) among the listed pairs, by merging both sorted lists
                both = np.lexsort((np.repeat([0, 1], [pair.shape[1], len(m)]), np.concatenate([pair[1], m]), np.concatenate([pair[0], text])))
                last = np.maximum.accumulate(np.where(both < pair.shape[1], both, -1))
                hit = np.empty(len(m), np.int64)
                mine = both >= pair.shape[1]
                hit[both[mine] - pair.shape[1]] = last[mine]
                there = hit >= 0
                there[there] = (pair[0][hit[there]] == text[there]) & (pair[1][hit[there]] == m[there])
                take = np.flatnonzero(there)
                parts = parts[hit[take]]
                raw = words.data.tobytes()
                strings = [b" ".join(raw[b:e].split()) for b, e in zip(words.start[at[take]].tolist(), words.end[at[take] + n[take] + width - 2].tolist(), strict=True)]
                of = pa.array(text[take])
                kd, k, place = rows.column(0).take(of), rows.column(1).take(of), (at - words.first[text])[take]
                salt = mix(mix(kd.to_numpy().view(np.uint64)) ^ mix(k.to_numpy().view(np.uint64), 1) ^ place.astype(np.uint64), 2) % parts.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(m[take]), pa.array(salt.astype(np.int64)), pa.array(parts), pa.array(strings, pa.binary()).cast(pa.string()), kd, k, pa.array(place)], names)

    def sorted_parts(batches: Iterator[pa.RecordBatch], split: bool):
        """Of each run of whole parts (``split``: of minimisers with several): its table, words, windows' places, their
        text, the order and who equals the one before."""
        for table, at in groups((b.filter(pc.greater(b.column(2), 1)) if split else b for b in batches), 2):
            words = Words(table.column(3).combine_chunks())
            hashes, where = words.grams(width)
            row = words.text_of(where)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))[row]
            yield table, words, where, row, *_clusters(words, hashes, where, of, width)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of the windows that are repeated in their part."""
        for table, words, where, row, order, alike in sorted_parts(batches, False):
            repeated = np.zeros(len(where), bool)
            repeated[order[alike]] = True
            repeated[order[:-1][alike[1:]]] = True
            owner, place, length = _runs(repeated, row, where - words.first[row])
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays([table.column(4).combine_chunks().take(of), table.column(5).combine_chunks().take(of), pa.array(place + table.column(6).to_numpy()[owner]), pa.array(length)], ["kd", "k", "place", "length"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record of each distinct window of a part, packed by bin."""
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            records = np.concatenate(held)
            held.clear()
            records = records[np.argsort(records["one"] % np.uint64(bins), kind="stable")]
            at = (records["one"] % np.uint64(bins)).astype(np.int32)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            blobs = [records[i:j].tobytes() for i, j in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(blobs, pa.binary())], ["bin", "records"])

        for table, words, where, row, order, alike in sorted_parts(batches, True):
            pick = order[~alike]
            raw = words.data.tobytes()
            digests = b"".join(blake2b(raw[b:e], digest_size=16).digest() for b, e in zip(words.start[where[pick]].tolist(), words.end[where[pick] + width - 1].tolist(), strict=True))
            records = np.zeros(len(pick), _RECORD)
            both = np.frombuffer(digests, "<u8").reshape(-1, 2)
            records["one"], records["two"] = both[:, 0], both[:, 1]
            records["kd"], records["k"] = table.column(4).to_numpy()[row[pick]], table.column(5).to_numpy()[row[pick]]
            records["place"] = (where - words.first[row])[pick] + table.column(6).to_numpy()[row[pick]]
            held.append(records)
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of the windows that came from two parts."""
        for table, at in groups(batches, 1, 16):
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                records = np.frombuffer(b"".join(table.column(1).slice(low, high - low).to_pylist()), _RECORD)
                records = records[np.lexsort((records["two"], records["one"]))]
                same = (records["one"][1:] == records["one"][:-1]) & (records["two"][1:] == records["two"][:-1])
                found = records[np.append(same, False) | np.append(False, same)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(found[c])) for c in ("kd", "k", "place")), pa.array(np.ones(len(found), np.int64))], ["kd", "k", "place", "length"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                total, removed, kept = [], [], []
                for text, gone in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
                    words = (text or "").encode().split()
                    out = 0
                    if gone.is_valid:
                        cover = np.zeros(len(words) + 1, np.int64)
                        place = gone.values.field("place").to_numpy()
                        np.add.at(cover, place, 1)
                        np.add.at(cover, place + gone.values.field("length").to_numpy() + width - 1, -1)
                        stay = np.cumsum(cover)[:-1] == 0
                        out = len(words) - int(stay.sum())
                        kept.append(b" ".join(compress(words, stay.tolist())))
                    else:
                        kept.append(b" ".join(words))
                    total.append(len(words))
                    removed.append(out)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(2**63))).alias("kd"), F.xxhash64(id_, text).alias("k"), text.alias("text"))
    seen = rows.select("kd", "k", "text").mapInArrow(minimisers, "kd long, k long, m long, n long")
    twice = seen.groupBy("m").agg(F.sum("n").alias("c")).filter("c > 1").select("m", F.ceil(F.col("c") / part).cast("long").alias("parts"))
    lists = seen.join(twice, "m").groupBy("kd", "k").agg(F.collect_set(F.struct("m", "parts")).alias("listed"))
    keyed = rows.repartition("kd", "k")  # both uses below read all its columns, so that it is shuffled once
    packed = keyed.join(lists.hint("shuffle_hash"), ["kd", "k"]).select("kd", "k", "text", "listed", "doc_id").mapInArrow(pack, "m long, salt long, parts long, s string, kd long, k long, place long")
    dealt = packed.repartition("m", "salt").sortWithinPartitions("m", "salt")
    spans = "kd long, k long, place long, length long"
    within = dealt.mapInArrow(repeats, spans)
    records = dealt.mapInArrow(distinct, "bin int, records binary")
    across = records.repartition(partitions, "bin").sortWithinPartitions("bin").mapInArrow(meet, spans)
    ranges = within.unionByName(across).groupBy("kd", "k").agg(F.collect_list(F.struct("place", "length")).alias("gone"))
    return keyed.join(ranges.hint("shuffle_hash"), ["kd", "k"], "left").select("doc_id", "text", "gone", "kd", "k").mapInArrow(finish, RESULT)
