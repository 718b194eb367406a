"""N-gram Jaccard self-join of documents by chosen paths.

A document is its set of runs of ``k`` words (a text of fewer words: one run of all of them).

1. Documents with equal sets are one *text*; the join is between texts, weighted by their copies.
2. A text is embedded as ``width`` MinHash tokens (position, least hash), whose expected overlap is the Jaccard similarity.
3. Chosen paths: every run starts from all texts in one bucket and recursively splits a bucket on sampled shared tokens.
   At a path each position is sampled with probability 1 / (lam * width), the same for all texts there, and texts with
   an equal token go to the child (path, position, token).  A bucket of at most ``small`` texts is not split again, nor after
   ``depth`` splits one of at most ``block``, nor one whose texts are mostly alike (the mean agreement of its pairs, counted on eight
   positions, is no less than brute force asks for): such a group of near copies has its links inside.  Others are split up to ``deeper`` times more, with ``lam_deeper``.
   Runs repeat until a pair at the threshold has been together in a final bucket with probability ``recall`` below all
   splits; the number follows from the sampling rates.
4. Buckets with the same members are kept once.  Inside a bucket all pairs are tried by brute force on their sketches;
   pairs well above chance join into candidate groups (a spanning forest of links leaves a task, never all pairs).
5. The exact check: inside every candidate group all pairs of texts are compared by their whole sets.  Links are
   counted at both ends; classes are the connected components of the links.

Buckets and groups of any size are cut into blocks (of at most ``block`` texts; groups also by ``block_shingles``) and each pair
of blocks is a task's work of its own, so a group of a third of all texts is spread out, no list of pairs is ever made, and no
link inside it is lost.  A text of a group of c texts is sent c / ``block`` times: the *comparisons* in a group of different
near copies are quadratic (each text's number of links asks for them), what is sent is c until ``block`` and c**2 / ``block`` beyond.
Texts are told apart by 128 bits of their sets, shingles by 64 bits.

Result: one row for each input row with class_id (least doc_id of its class; class_hash is that row's hash of the text), n_links (other rows with similarity of at
least the threshold, copies included), n_copies (rows with an equal set).  Nulls: a null text, or one without words, has
no links and is in a class of its own doc_id; null doc_ids count as rows but never name a class of others.
Repeated rows are copies.  Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components, least_reachable
from quillspan.llm.shared import free, written
from quillspan.llm.words import Words, groups, mix, slices

_NODE = "s1 long, s2 long, owner long, n int, sketch binary"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's runs of k words, sorted, and where each text's begin."""
    words = Words(texts)
    g, at = words.grams(k)
    owner = words.text_of(at)
    count = np.diff(words.first)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        total = np.zeros(len(words.hash) + 1, np.uint64)
        np.cumsum(mix(words.hash ^ np.arange(len(words.hash), dtype=np.uint64) - words.first[words.text_of(np.arange(len(words.hash)))].astype(np.uint64), 7), out=total[1:])
        g = np.concatenate([g, mix(total[words.first[few + 1]] - total[words.first[few]], 9)])
        owner = np.concatenate([owner, few])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[keep], owner[keep]
    return g, np.searchsorted(owner, np.arange(len(texts) + 1))


def signature(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, from sums over its members; 0, 0 for empty sets."""
    out = []
    for seed in (11, 12):
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(mix(g, seed), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(g: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """texts x width MinHash tokens (uint32); an empty set gets the greatest token."""
    n = len(first) - 1
    out = np.full((n, width), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        rng = np.random.Generator(np.random.PCG64(20))
        mul, add = rng.integers(0, 2**63, (2, width), np.uint64)
        for low in range(0, len(full), 512):  # small enough for the cache
            part = full[low : low + 512]
            piece, at = g[first[part[0]] : first[part[-1] + 1]], first[part] - first[part[0]]
            for i in range(width):
                out[part, i] = np.minimum.reduceat((piece * (mul[i] * np.uint64(2) + np.uint64(1)) + add[i]) >> np.uint64(32), at)
    return out


def runs_needed(similarity: float, rates: list[float], width: int, recall: float) -> int:
    """Runs after which a pair at the similarity has met below all splits with the recall: at each path a shared position
    is sampled with probability 1 / (rate * width); the chance to be still together is that of a branching process."""
    lost = 0.0
    for rate in reversed(rates):
        lost = (1 - similarity / (rate * width) * (1 - lost)) ** width
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _children(path: np.ndarray, sketch: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the sampled positions of each row's path."""
    width = sketch.shape[1]
    share = np.uint64(int(2**64 / (lam * width)))
    rows, out = [], []
    for i in range(width):
        at = np.flatnonzero(mix(path, 100 + i) < share)
        rows.append(at)
        out.append(mix(mix(path[at], 300 + i) ^ sketch[at, i].astype(np.uint64), 1))
    return np.concatenate(rows), np.concatenate(out)


def _sketch_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), np.uint32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * 0 :]
    offsets = np.frombuffer(column.buffers()[1], np.int64 if column.type == pa.large_binary() else np.int32)[column.offset : column.offset + len(column) + 1]
    return data[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, width) if (offsets[0] % 4 == 0) else np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint32).reshape(-1, width)


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: adds x <= y and the row's own block."""
    n = F.greatest(F.lit(1), F.ceil(blocks)).cast("int")
    own = F.pmod(F.xxhash64("s1", "s2", F.lit(5)), n).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def _squares(mine: np.ndarray, theirs: np.ndarray, same: bool, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows as pairs of short runs of rows; if both sides are the same, each pair of runs once."""
    for i in range(0, len(mine), side):
        for j in range(i if same else 0, len(theirs), side):
            yield mine[i : i + side], theirs[j : j + side]


def _candidates(width: int, least: float):
    """Of rows sorted by (path, x, y) with own, s1, sketch: links of a spanning forest of each block pair's matches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, 3):
            x, y, own = (table.column(i).to_numpy() for i in (1, 2, 3))
            s1, sketch = table.column(4).to_numpy(), _sketch_of(table.column(5), width)
            size = np.diff(at)
            a, b = [], []
            two = at[:-1][(size == 2) & (x[at[:-1]] == y[at[:-1]])]  # most buckets
            hit = (sketch[two] == sketch[two + 1]).mean(1) >= least if len(two) else np.zeros(0, bool)
            a.append(s1[two[hit]])
            b.append(s1[two[hit] + 1])
            for low, n in zip(at[:-1].tolist(), size.tolist(), strict=True):
                same = x[low] == y[low]
                if n < 2 or n == 2 and same:
                    continue
                part, side = sketch[low : low + n], own[low : low + n]
                mine = np.arange(n) if same else np.flatnonzero(side == x[low])
                theirs = mine if same else np.flatnonzero(side == y[low])
                root = np.arange(n)
                for p, q in _squares(mine, theirs, same, 1024):
                    near = np.zeros((len(p), len(q)), np.int16)
                    for i in range(width):
                        near += part[p, i, None] == part[None, q, i]
                    i, j = np.nonzero(near >= least * width)
                    root = least_reachable(np.append(p[i], np.arange(n)), np.append(q[j], root), n)
                far = np.flatnonzero(root != np.arange(n))
                a.append(s1[low + far])
                b.append(s1[low + root[far]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return work


def _common(left_sets: list[np.ndarray], right_sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of left sets with right sets, by products of 0/1 matrices over shared members."""
    sets, mine = left_sets + right_sets, np.arange(len(left_sets))
    theirs = np.arange(len(left_sets), len(sets))
    out = np.zeros((len(mine), len(theirs)), np.float32)
    g = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(g, kind="stable")
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    member = np.cumsum(new) - 1
    shared = np.bincount(member)[member] > 1
    member, owner = member[shared], owner[shared]
    _, member = np.unique(member, return_inverse=True)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[mine], col[theirs] = np.arange(len(mine)), np.arange(len(theirs))
    for low in range(0, int(member.max()) + 1 if len(member) else 0, 8192):
        i, j = np.searchsorted(member, [low, low + 8192])
        m, o = member[i:j] - low, owner[i:j]
        left, right = np.zeros((len(mine), 8192), np.float32), np.zeros((len(theirs), 8192), np.float32)
        left[row[o[row[o] >= 0]], m[row[o] >= 0]] = 1
        right[col[o[col[o] >= 0]], m[col[o] >= 0]] = 1
        out += left @ right.T
    return out


def _exact(k: int, least: float):
    """Of rows sorted by (group, x, y): links counted for each text, and a spanning forest of the links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, 3, 2000):
            out: list[list[np.ndarray]] = [[], [], [], []]
            own, s1, s2, copies = (table.column(i).to_numpy() for i in (3, 4, 5, 6))
            x, y = table.column(1).to_numpy(), table.column(2).to_numpy()
            texts = table.column(7).combine_chunks()
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                g, first = shingle_sets(texts.slice(low, high - low), k)
                one, two = signature(g, first)
                good = (one == s1[low:high]) & (two == s2[low:high])  # another text under the same doc_id
                pick = np.flatnonzero(good)
                if len(pick):
                    _, once = np.unique(s1[low + pick], return_index=True)
                    pick = pick[np.sort(once)]
                if not len(pick):
                    continue
                sets = [g[first[i] : first[i + 1]] for i in pick]
                rows = low + pick
                same = x[low] == y[low]
                mine = np.arange(len(pick)) if same else np.flatnonzero(own[rows] == x[low])
                theirs = mine if same else np.flatnonzero(own[rows] == y[low])
                n = np.array([len(s) for s in sets])
                links, root = np.zeros(len(pick), np.int64), np.arange(len(pick))
                for p, q in _squares(mine, theirs, same, 512):
                    both = _common([sets[i] for i in p], [sets[j] for j in q])
                    hit = both >= least * (n[p][:, None] + n[q][None, :] - both) - 1e-3
                    if within := same and p[0] == q[0]:
                        np.fill_diagonal(hit, False)
                    links[p] += hit @ copies[rows[q]]
                    if not within:
                        links[q] += hit.T @ copies[rows[p]]
                    i, j = np.nonzero(hit)
                    root = least_reachable(np.append(p[i], np.arange(len(pick))), np.append(q[j], root), len(pick))
                for col, value in zip(out, (s1[rows], s2[rows], links, s1[rows[root]]), strict=True):
                    col.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["s1", "s2", "links", "root"])

    return work


def near_duplicates(docs: DataFrame, similarity: float = 0.8, k: int = 5, width: int = 64, lam: float = 0.8, depth: int = 3, small: int = 64, recall: float = 0.999, block: int = 4096, block_shingles: int = 1 << 20, deeper: int = 6, lam_deeper: float = 0.5) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each row of docs(doc_id, text)."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                g, first = shingle_sets(part.column(2), k)
                s1, s2 = signature(g, first)
                raw = sketches(g, first, width).tobytes()
                offsets = pa.py_buffer((np.arange(part.num_rows + 1) * 4 * width).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s1), pa.array(s2), pa.array(np.diff(first).astype(np.int32)), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(raw)])], ["doc_id", "text_hash", "s1", "s2", "n", "sketch"])

    def split(rate: float):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                path = batch.column(0).to_numpy().view(np.uint64)
                row, child = _children(path, _sketch_of(batch.column(3), width), rate)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows)], ["path", "s1", "s2"])

        return work

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketch_of(batch.column(1), width)[:, :8]
            n = sketch.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(sketch.ravel().astype(np.int64))], ["path", "place", "token"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch, n = _sketch_of(batch.column(2), width), batch.num_rows
            for run in range(runs):
                root = np.full(n, mix(np.array([run], np.uint64), 77)[0])
                row, child = _children(root, sketch, lam)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], ["path", "s1", "s2"])

    runs = runs_needed(similarity, [lam] * depth + [lam_deeper] * deeper, width, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = written(source.mapInArrow(embed, "doc_id long, text_hash long, s1 long, s2 long, n int, sketch binary"), "sketches")
    owner = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    texts = written(rows.filter("n > 0").groupBy("s1", "s2").agg(F.min(owner).alias("owner"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "texts")

    finals, step = None, 0
    level = texts.select("s1", "s2", "sketch").mapInArrow(start, "path long, s1 long, s2 long")
    sketched = texts.select("s1", "s2", "sketch")
    while level is not None:
        step += 1
        level = written(level, f"paths-{step}")
        sizes = level.groupBy("path").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("s1", "s2")).alias("who")).filter("c > 1")
        if step < depth:
            on = sizes.filter(F.col("c") > small).select("path")
        else:  # splits go on in buckets of more than a block whose texts are not mostly alike
            sizes = written(sizes, f"sizes-{step}")  # read by what goes on and by what is done
            on = sizes.filter(F.col("c") > block).select("path", "c")
            many = None if step == depth + deeper or on.isEmpty() else level.join(on, "path").join(sketched, ["s1", "s2"])
            if many is not None:
                alike = many.select("path", "sketch").mapInArrow(tokens, "path long, place int, token long").groupBy("path", "place", "token").count()
                alike = alike.groupBy("path").agg((F.sum(F.col("count").cast("double") * F.col("count")) / min(8, width)).alias("alike"))
                on = written(on.join(alike, "path").filter(F.col("alike") < (similarity - 0.2) * F.col("c") * F.col("c")).select("path"), f"mixed-{step}")
            if many is None or on.isEmpty():
                on = None
        done = level.join(sizes if on is None else sizes.join(on, "path", "left_anti"), "path")
        finals = done if finals is None else finals.unionByName(done)
        level = None if on is None else level.join(on, "path").join(sketched, ["s1", "s2"]).select("path", "s1", "s2", "sketch").mapInArrow(split(lam if step < depth else lam_deeper), "path long, s1 long, s2 long")
    kept = finals.groupBy("path").agg(F.first("c").alias("c"), F.first("who").alias("who")).groupBy("c", "who").agg(F.min("path").alias("path"))
    finals = finals.drop("c", "who").join(kept.select("path", "c"), "path")
    blocks = _in_blocks(finals.join(texts.select("s1", "s2", "sketch"), ["s1", "s2"]), F.col("c") / block).select("path", "x", "y", "own", "s1", "sketch")
    edges = blocks.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y").mapInArrow(_candidates(width, similarity - 0.2), "a long, b long")

    found = components(edges)  # by s1: two texts with equal 64 bits only share a candidate group
    member = texts.select("s1", "s2", "owner", "copies", "n").join(found.withColumnRenamed("node", "s1"), "s1")
    size = member.groupBy("component").agg(F.greatest(F.count("*") / block, F.sum("n") / block_shingles).alias("c"))
    member = written(member.drop("n").join(size, "component"), "members")
    wanted = member.select("component", "c", "s1", "s2", "copies", F.col("owner.doc_id").alias("id"), F.col("owner.text_hash").alias("h"))
    whole = source.join(wanted.hint("shuffle_hash"), source["doc_id"].eqNullSafe(F.col("id")) & (source["text_hash"] == F.col("h")))
    blocks = _in_blocks(whole, F.col("c")).select("component", "x", "y", "own", "s1", "s2", "copies", "text")
    pairs = written(blocks.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "own").mapInArrow(_exact(k, similarity), "s1 long, s2 long, links long, root long"), "links")
    links = pairs.groupBy("s1", "s2").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.count_distinct("root").alias("roots"))
    if member.filter("c > 1").isEmpty():  # every group was one block: its forest is complete
        classes = links.withColumnRenamed("root", "class")
    else:
        joined = components(pairs.select(F.col("s1").alias("a"), F.col("root").alias("b")))
        classes = links.join(joined.withColumnRenamed("node", "s1").withColumnRenamed("component", "class"), "s1", "left").withColumn("class", F.coalesce("class", "s1"))
    name = classes.join(member.select("s1", "s2", "owner"), ["s1", "s2"]).groupBy("class").agg(F.min("owner").alias("first"))
    classes = classes.join(name, "class").select("s1", "s2", "links", "first")
    known = texts.select("s1", "s2", "owner", "copies").join(classes, ["s1", "s2"], "left")
    out = rows.select("doc_id", "text_hash", "s1", "s2", "n").join(known, ["s1", "s2"], "left")
    some = F.col("n") > 0
    first = F.when(some, F.coalesce("first", "owner")).otherwise(owner)
    links = F.when(some, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    return out.select("doc_id", first["doc_id"].alias("class_id"), links.cast("long").alias("n_links"), F.when(some, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"), first["text_hash"].alias("class_hash"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: the least doc_id, then the least hash of the text; equal rows count once.
    All columns are kept.  Rows without words stay, once for each doc_id."""
    found = near_duplicates(docs, **options)
    kd, kh = free(docs, "kd"), free(docs, "kh")
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    stay = found.select(key(F.col("class_id")).alias(kd), F.col("class_hash").alias(kh)).distinct()
    keyed = docs.withColumn(kd, key(F.col("doc_id"))).withColumn(kh, F.xxhash64(F.col("text").cast("string")))
    once = keyed.dropDuplicates([kd, kh])  # a row that is repeated often leaves each task once
    return once.join(stay.hint("shuffle_hash"), [kd, kh], "left_semi").drop(kd, kh).select(*docs.columns)
