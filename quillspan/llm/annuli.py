"""Hard-negative mining by one-dimensional distance keys.

Rows are integer vectors.  A row x is augmented with sqrt(M - |x|**2), M being the largest |x|**2, an anchor q with 0; then
|q' - x'|**2 = |q|**2 + M - 2 q.x, so the greatest inner products are the nearest rows.  Each augmented row has a key (pivot, distance to it), the pivot
being the nearest of a few.  Rows are stored sorted by key, in blocks of ``block`` rows of one pivot: a block is an annulus (pivot, least and
greatest distance).  By the triangle inequality the distances of an anchor to a pivot and of a block's annulus to it bound the scores that the block can
hold, above and below.

A search takes blocks by falling bound in rounds that expand: the first 4, the next 28, 224, 1792, then 4096 a time.  After each round the
scores found so far bound what is left, and an anchor goes on only to blocks whose annulus can still hold a row that it
wants.  When no block is left, the remaining bound certifies its first k.  Nothing is approximated: bounds are widened by more than their
rounding error, scores are integers, and the vectors of all blocks within reach are multiplied out.

An anchor's positives are its first ``n_positives`` other rows of its label; for each of them the first ``n_negatives`` rows of other labels are sought whose score s has
least * positive_score <= 100 * s <= most * positive_score.  Higher scores come first, ties by smaller vec_id (null last).

Scale: anchors travel in blocks of ``anchors`` rows; a task holds one block of each kind.  A block's anchors go only to blocks that at least one
of them needs, so the work is anchors times rows within reach.  Their joins are hinted to sort and merge, since sizes guessed from
files would have vectors sent to all tasks; vectors travel as 16-bit numbers where they fit.  The blocks' directory (four numbers a block) is sent to all tasks:
blocks grow with the table so that it has at most 65,536 entries and one more for each pivot and task.  Rows with one key (copies) are
split over blocks.  Pivots are means of a sample of 2,048 rows with the least hashes; they decide the work, not the result.

Nulls: rows with a null label, a null vector or a null or non-finite component take no part.  A null vec_id is no anchor.  Repeated rows count as often as they come, as
anchors too.  Vectors of different lengths: missing components are 0.  Squared lengths beyond 2**55 raise ArithmeticError, for scores would not
fit.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import shared_folder, written

_MOST = 2**62
_LARGEST = 2.0**55
_ENTRIES = 65_536
_SAMPLE = 2_048
FOUND = "ab long, q int, w int, score long, vec_id long, row long"
_BLOCKS = "rb long, pivot int, lo double, hi double, n int, n_anchors int, ids array<long>, labels array<long>, anchor array<boolean>, vecs binary"


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~wrong


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to one width."""
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _centres(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` means of the points."""
    centres = points[:n]
    for _ in range(8 if len(points) > n else 0):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        centres = np.stack([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


@dataclass
class _Reach:
    """What all tasks know: the pivots and the directory of blocks."""

    width: int
    largest: float
    store: str
    pivots: np.ndarray
    rb: np.ndarray
    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))])

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def scores(self, x: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that each anchor can have in each of the blocks."""
        x = x.astype(np.float64)
        square = (x * x).sum(1)[:, None] + self.largest
        d = self.to_pivots(np.column_stack([x, np.zeros(len(x))]))[:, self.pivot[blocks]]
        near = np.maximum(np.maximum(self.lo[blocks] - d, d - self.hi[blocks]), 0)
        far = d + self.hi[blocks]
        slack = 1e-6 * square + 1
        return (square - far**2) / 2 - slack, (square - near**2) / 2 + slack


class Index:
    """Blocks of rows sorted by (pivot, distance), in the shared folder."""

    def __init__(self, rows: DataFrame, n_pivots: int = 32, block: int = 2048, anchors: int = 1024):
        """rows(vec_id long, label long, vec array<long>, anchor boolean), all of them usable."""
        self.spark, self.anchors = rows.sparkSession, anchors
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        rows = written(rows.select("vec_id", "label", "vec", "anchor", square.alias("square")), "vectors")
        stats = rows.agg(F.max("square").alias("largest"), F.max(F.size("vec")).alias("width"), F.count("*").alias("n")).first()
        if (stats.largest or 0) > _LARGEST:
            raise ArithmeticError("scores of vectors this long do not fit a long")
        self.width, largest = stats.width or 0, stats.largest or 0
        self.kind = "f4" if largest < 2.0**24 else "f8" if largest < 2.0**52 else "i8"  # the smallest in which all sums are exact
        empty = np.zeros(0)
        self.reach = _Reach(self.width, float(largest), "<i2" if largest < 2.0**30 else "<i4", np.zeros((0, self.width + 1)), empty, empty, empty, empty)
        sample = [r.vec for r in rows.orderBy(F.xxhash64("vec"), "vec").limit(_SAMPLE).select("vec").collect()]
        if sample:
            self.reach.pivots = _centres(self.reach.augmented(_matrix(pa.array(sample, pa.list_(pa.int64())), self.width)), n_pivots)
        block = max(block, -(-stats.n // _ENTRIES))
        path = shared_folder(self.spark, "annuli")
        keyed = self._keyed(rows).withColumn("spread", F.monotonically_increasing_id())  # rows of one key are split
        order = ["pivot", "dist", "spread"]
        sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
        sorted_.mapInArrow(_packed(block, self.width, self.reach.store), _BLOCKS).write.parquet(path)
        self.blocks = self.spark.read.schema(_BLOCKS).parquet(path)
        found = sorted(map(tuple, self.blocks.select("pivot", "lo", "rb", "hi", "n_anchors").collect()))
        pivot, lo, rb, hi, n_anchors = (np.array(c) for c in zip(*found, strict=True)) if found else [empty.astype(np.int64)] * 5
        self.reach.rb, self.reach.pivot, self.reach.lo, self.reach.hi = rb, pivot, lo, hi
        self.first_anchor = dict(zip(rb.tolist(), (np.cumsum(n_anchors) - n_anchors).tolist(), strict=True))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        reach = self.spark.sparkContext.broadcast(self.reach)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = reach.value
            for batch in batches:
                d = r.to_pivots(r.augmented(_matrix(batch.column("vec"), r.width))) if batch.num_rows else np.zeros((0, 1))
                near = np.argmin(d, axis=1)
                cols = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in ("vec_id", "label", "vec", "anchor"))], ["pivot", "dist", "vec_id", "label", "vec", "anchor"])

        return rows.select("vec_id", "label", "vec", "anchor").mapInArrow(work, "pivot int, dist double, vec_id long, label long, vec array<long>, anchor boolean")

    def queries(self) -> DataFrame:
        """The anchors in blocks (ab, rows, ids, labels, vecs), in the order of their keys."""
        first, size, width, store = self.spark.sparkContext.broadcast(self.first_anchor), self.anchors, self.width, self.reach.store

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rb, ids, labels, anchor, vecs = (batch.column(c)[i] for c in ("rb", "ids", "labels", "anchor", "vecs"))
                    at = np.flatnonzero(anchor.values.to_numpy(zero_copy_only=False))
                    rows = pa.array(at)
                    x = _vectors(vecs, width, store)[at]
                    ab = (first.value[rb.as_py()] + np.arange(len(at))) // size
                    packed = pa.array([v.tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ab), pa.array(at + _row(rb.as_py())), ids.values.take(rows), labels.values.take(rows), packed], ["ab", "row", "vec_id", "label", "vec"])

        blocks = self.blocks.filter("n_anchors > 0").select("rb", "ids", "labels", "anchor", "vecs")
        rows = blocks.groupBy("rb").applyInArrow(_by_batch(work), "ab long, row long, vec_id long, label long, vec binary")
        packed = F.sort_array(F.collect_list(F.struct("row", "vec_id", "label", "vec")))
        cols = {"rows": "row", "ids": "vec_id", "labels": "label", "vecs": "vec"}
        return rows.groupBy("ab").agg(packed.alias("p")).select("ab", *[F.col(f"p.{f}").alias(c) for c, f in cols.items()])

    def search(self, queries: DataFrame, same: bool, k: int, wants: int = 1) -> DataFrame:
        """FOUND and ``rank``: the first k rows of the same (or another) label for each anchor and want.  ``queries`` may have a column
        ``ranges`` of (q, w, lo, hi): only scores from lo to hi count, and only for wants that have a range."""
        reach = self.spark.sparkContext.broadcast(self.reach)
        best = Window.partitionBy("ab", "q", "w").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
        found, low, span = None, 0, 4
        while low < len(self.reach.rb) or found is None:
            asked = queries
            if found is not None:
                kth = F.collect_list(F.struct("q", "w", "score"))
                asked = queries.join(found.filter(F.col("rank") == k).groupBy("ab").agg(kth.alias("best")).hint("merge"), "ab", "left")
            planned = asked.groupBy("ab").applyInArrow(_planned(reach, low, low + span, wants), "rb long, ab long, qs array<int>, rows array<long>, labels array<long>, vecs binary, floor array<long>, top array<long>")
            pairs = planned.join(self.blocks.select("rb", "ids", F.col("labels").alias("block_labels"), F.col("vecs").alias("block_vecs")).hint("merge"), "rb")
            new = pairs.mapInArrow(_scanned(self.width, self.reach.store, self.kind, same, k, wants), FOUND)  # a row is a block and its anchors
            new = new if found is None else new.unionByName(found.drop("rank"))
            found = written(new.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "annuli-found")
            low, span = low + span, min(4096, 28 if low == 0 else span * 8)
        return found


def _row(rb: int) -> int:
    """The number of a block's first row; a block has fewer than 2**24."""
    return rb << 24


def _vectors(value: pa.Scalar, width: int, store: str) -> np.ndarray:
    """The vectors in a binary value."""
    raw = np.frombuffer(value.as_buffer(), store)
    return raw.reshape(-1, width) if width else np.zeros((0, 0), store)


def _by_batch(work):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    return each


def _packed(block: int, width: int, store: str):
    """Sorted rows to blocks of one pivot; within a block rows are in the order of ties."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id, held = TaskContext.get().partitionId() << 20, None

        def one(part: pa.Table) -> pa.RecordBatch:
            nonlocal next_id
            dist = part.column("dist").to_numpy()
            pivot = part.column("pivot")[0].as_py()
            part = part.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
            ids, labels, anchor, vec = (part.column(c).combine_chunks() for c in ("vec_id", "label", "anchor", "vec"))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in (ids, labels, anchor)]
            x = _matrix(vec, width).astype(store).tobytes()
            row = [[next_id], [pivot], [float(dist[0])], [float(dist[-1])], [len(part)], [anchor.true_count]]
            next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()), strict=True)] + [*lists, pa.array([x], pa.binary())], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            pivot = table.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            held = None
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                while high - low >= block or (high < len(pivot) and high > low):
                    yield one(table.slice(low, min(block, high - low)))
                    low += min(block, high - low)
                if high > low:
                    held = table.slice(low, high - low)
        if held is not None and len(held):
            yield one(held)

    return work


def _of(structs: list[dict] | None, shape: tuple[int, int], field: str, other: int) -> np.ndarray:
    out = np.full(shape, other, np.int64)
    if structs:
        out[[x["q"] for x in structs], [x["w"] for x in structs]] = [x[field] for x in structs]
    return out


def _planned(reach, low: int, high: int, wants: int):
    """For a block of anchors: what goes to each of the blocks low .. high - 1 in the order of their bounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reach.value
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                rows, labels = (value[c].values.to_numpy(zero_copy_only=False) for c in ("rows", "labels"))
                raw = value["vecs"].values
                x = np.frombuffer(b"".join(raw.to_pylist()), r.store).reshape(len(rows), r.width)
                shape = (len(rows), wants)
                ranged = "ranges" in value
                ranges = value["ranges"].as_py() if ranged else None
                top = _of(ranges, shape, "hi", -_MOST if ranged else _MOST)
                floor = _of(ranges, shape, "lo", _MOST if ranged else -_MOST)
                if "best" in value:
                    floor = np.maximum(floor, _of(value["best"].as_py(), shape, "score", -_MOST))
                chunk = max(1, (1 << 21) // max(1, len(rows)))
                most = [r.scores(x, np.arange(at, min(at + chunk, len(r.rb))))[1].max(0) for at in range(0, len(r.rb), chunk)]
                order = np.argsort(-np.concatenate(most), kind="stable")[low:high] if most else np.zeros(0, np.int64)
                for at in range(0, len(order), chunk):
                    blocks = order[at : at + chunk]
                    least, greatest = r.scores(x, blocks)
                    wanted = np.zeros(least.shape, bool)
                    for w in range(wants):
                        wanted |= (greatest >= floor[:, w : w + 1]) & (least <= top[:, w : w + 1])
                    for b in np.flatnonzero(wanted.any(0)).tolist():
                        q = np.flatnonzero(wanted[:, b])
                        cols = [pa.array([r.rb[blocks[b]]], pa.int64()), pa.array([value["ab"].as_py()], pa.int64()), _lists(q.astype(np.int32)), _lists(rows[q]), _lists(labels[q])]
                        cols += [pa.array([x[q].tobytes()], pa.binary()), _lists(floor[q].ravel()), _lists(top[q].ravel())]
                        yield pa.RecordBatch.from_arrays(cols, ["rb", "ab", "qs", "rows", "labels", "vecs", "floor", "top"])

    return _by_batch(work)


def _scanned(width: int, store: str, kind: str, same: bool, k: int, wants: int, step: int = 128):
    """The first k wanted rows of a block for each of the anchors that came to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                numbers = lambda c: value[c].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                labels, qs, rows = numbers("block_labels"), numbers("qs"), numbers("rows")
                x, y = _vectors(value["block_vecs"], width, store).astype(kind), _vectors(value["vecs"], width, store).astype(kind)
                if not width:
                    x, y = np.zeros((len(labels), 1), kind), np.zeros((len(qs), 1), kind)
                floor, top = numbers("floor").reshape(-1, wants), numbers("top").reshape(-1, wants)
                place = rows - _row(value["rb"].as_py())
                mine, ids = numbers("labels"), value["ids"].values
                reach = lambda v: np.clip(v, -(2**62), 2**62).astype(kind) if kind == "i8" else np.clip(v, -(2.0**53), 2.0**53).astype(kind)
                least, most = reach(floor.min(1)), reach(top.max(1))  # of any want; what passes is tried on each
                for low in range(0, len(qs), step):
                    part = slice(low, low + step)
                    score = y[part] @ x.T
                    q, at = np.nonzero((score >= least[part, None]) & (score <= most[part, None]))
                    s = score[q, at].astype(np.int64)
                    good = ((mine[part][q] == labels[at]) == same) & (at != place[part][q])
                    q, at, s = q[good], at[good], s[good]
                    order = np.lexsort((at, -s, q))
                    q, at, s = q[order], at[order], s[order]
                    for w in range(wants):
                        fits = np.flatnonzero((s >= floor[part, w][q]) & (s <= top[part, w][q]))
                        if not len(fits):
                            continue
                        p = q[fits]
                        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                        fits = fits[np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p)))) < k]
                        cols = [pa.array(np.full(len(fits), value["ab"].as_py())), pa.array(qs[part][q[fits]]), pa.array(np.full(len(fits), w, np.int32)), pa.array(s[fits]), ids.take(pa.array(at[fits])), pa.array(at[fits] + _row(value["rb"].as_py()))]
                        yield pa.RecordBatch.from_arrays(cols, ["ab", "q", "w", "score", "vec_id", "row"])

    return work


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, n_pivots: int = 32, block: int = 2048, anchors: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, vec): integer vectors; scores are inner
    products."""
    anchor = F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    kept = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    index = Index(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"), anchor.alias("anchor")), n_pivots, block, anchors)
    queries = written(index.queries(), "annuli-anchors")
    positives = index.search(queries, True, n_positives)
    bounds = F.struct("q", (F.col("rank") - 1).alias("w"), F.expr(f"-((-{least} * score - pmod(-{least} * score, 100)) div 100)").alias("lo"), F.expr(f"({most} * score - pmod({most} * score, 100)) div 100").alias("hi"))
    ranged = queries.join(positives.groupBy("ab").agg(F.collect_list(bounds).alias("ranges")).hint("merge"), "ab")
    negatives = index.search(ranged, False, n_negatives, n_positives)
    named = queries.select("ab", F.posexplode("ids").alias("q", "anchor_id"))
    chosen = positives.select("ab", "q", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(chosen, ["ab", "q", "w"]).join(named, ["ab", "q"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
