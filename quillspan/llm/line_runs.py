"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case; keys of fewer than ``least_chars`` code points
are no candidates.  Keys are told by the 128 bits of their MD5.  Documents come in batches.  A batch's keys are aggregated
(``n``, documents that hold the key; ``holder``, the largest doc_id of the batch with it) and merge-anti-joined with all runs so far: keys
that no run has are new, and this batch holds them; of the others only ``n`` counts.  What results is the batch's own run.

Runs are bucketed by key and sorted in each bucket, all by the same number of buckets, so that a batch is shuffled once, by
its aggregation, and runs never are, to be joined or merged.  Each level holds one run; a second one of the same level is merged
with it into a run of the next level, so a table of b batches has at most log2(b) + 1 runs, and a key is rewritten as often.
(Runs are merged by full outer merge joins: a union of bucketed tables, grouped by key, gave a key two rows in Spark 4.1.2.)

``remove_common`` adds the documents of a table in batches of falling doc_id, so a key's holder is the largest doc_id that has it.  Keys
found in at least ``least_docs`` documents lose all their lines, except in the holder.

Recovery: lines, runs and the keys to drop are written to the folder that all executors share; a run counts once it
is written whole.  A frequent key has one row for each batch and run; its lines meet it in an equi-join that adaptive
execution splits.  Positions are gathered for one document at a time.

Nulls: a null text is empty, and an empty text is one empty line.  Rows with a null doc_id are the least; they come in the last batch.  Each row is a document
of its own: repeated rows count as often as they come, and all rows of the largest doc_id keep the line.  Very long texts and lines are worked
on whole.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.shared import shared_folder, written
from quillspan.llm.words import slices

#: Fixed value: what is stripped from both ends of a line.
_BLANK = " \t\n\x0b\x0c\r"
LINES = "doc_id long, doc_key long, key binary, places array<int>"


class LineRuns:
    """Runs of (key, n, holder, new) by level; ``add`` takes a batch, ``compact`` makes one run of all."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_folder(spark, "line-runs")
        self.levels: list[str | None] = []

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def _write(self, df: DataFrame) -> str:
        name = f"quillspan_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:  # the files stay in the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, batch: DataFrame) -> str:
        """Adds a batch(key, n, holder), a row for each key.  Rows that the anti-join of the batch with the runs leaves are
        ``new``; the others have no holder, for an earlier run has the key.  Returns the run's table, which stands until the next ``add``."""
        out, known = batch, F.lit(False)
        for i, name in enumerate(self.runs()):
            out = out.join(self.spark.table(name).select("key", F.lit(True).alias(f"seen{i}")).hint("merge"), "key", "left")
            known = known | F.coalesce(f"seen{i}", F.lit(False))
        run, level = self._write(out.select("key", "n", F.when(~known, F.col("holder")).alias("holder"), (~known).alias("new"))), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        self.levels[level : level + 1] = [run]
        return run

    def _merge(self, a: str, b: str) -> str:
        """One run of two; the one in which a key is new gives its holder."""
        x, y = self.spark.table(a).alias("x"), self.spark.table(b).alias("y")
        both = lambda c: F.coalesce(f"x.{c}", f"y.{c}")
        x_new, y_new = (F.coalesce(f"{t}.new", F.lit(False)) for t in "xy")
        n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        out = x.join(y.hint("merge"), F.col("x.key") == F.col("y.key"), "full")
        run = self._write(out.select(both("key").alias("key"), n.alias("n"), F.when(x_new, F.col("x.holder")).otherwise(F.col("y.holder")).alias("holder"), (x_new | y_new).alias("new")))
        self._drop(a, b)
        return run

    def compact(self) -> DataFrame:
        """All keys with all their documents, a row each."""
        names = self.runs()
        run = names[0]
        for name in names[1:]:
            run = self._merge(run, name)
        self.levels = [run]
        return self.spark.table(run)

    def close(self) -> None:
        self._drop(*self.runs())
        self.levels = []


def _keys(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, place, key) of the candidate lines."""
    lines = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
    offsets = lines.offsets.to_numpy()
    flat = lines.flatten()
    keys = pc.ascii_lower(pc.utf8_trim(flat, characters=_BLANK))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False))
    at = at.astype(np.int64)
    offsets = offsets - offsets[0]
    text = np.searchsorted(offsets, at, side="right") - 1
    md5 = hashlib.md5
    return text, at - offsets[text], [md5(x, usedforsecurity=False).digest() for x in keys.take(pa.array(at)).cast(pa.large_binary()).to_pylist()]


def lines(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """LINES of docs(doc_id, text): the places of each candidate key in each row; ``doc_key`` is a hash of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text, place, keys = _keys(part.column(2), least_chars)
                found: dict[tuple[int, bytes], list[int]] = {}
                for t, p, k in zip(text.tolist(), place.tolist(), keys, strict=True):
                    found.setdefault((t, k), []).append(p)
                rows = pa.array([t for t, _ in found], pa.int64())
                places = pa.array(list(found.values()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([k for _, k in found], pa.binary()), places], ["doc_id", "doc_key", "key", "places"])

    return _rows(docs).mapInArrow(work, LINES)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


def _bounds(docs: DataFrame, batches: int | None, batch_rows: int) -> list[int]:
    """Where batches end: doc_ids in falling order, so that each batch has about as many rows."""
    n = docs.count()
    batches = batches or max(6, -(-n // batch_rows))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 100 * batches)).first()[0] if n and batches > 1 else None
    return sorted(set(cuts or []), reverse=True)


def frequent(lines: DataFrame, bounds: list[int], least_docs: int = 5) -> DataFrame:
    """(key, holder) of the keys of at least ``least_docs`` rows; ``lines`` has a column ``batch``, numbered by falling doc_id."""
    runs = LineRuns(lines.sparkSession)
    for i in range(len(bounds) + 1):
        runs.add(lines.filter(F.col("batch") == i).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")))
    out = written(runs.compact().filter(F.col("n") >= least_docs).select("key", "holder"), "line-keys")
    runs.close()
    return out


def _without(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, places) without the lines at ``places``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts, places = part.column(1), part.column(2)
                n = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
                dropped = np.zeros(part.num_rows, np.int64)
                kept = texts
                if places.null_count < part.num_rows:
                    kept = texts.to_pylist()
                    for i in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        all_, gone = kept[i].split("\n"), set(places[i].as_py())
                        kept[i] = "\n".join([x for j, x in enumerate(all_) if j not in gone])
                        dropped[i] = len(gone)
                    kept = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(dropped), kept], ["doc_id", "n_lines", "n_dropped", "kept"])

    return docs.mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept string")


def remove_common(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int | None = None, batch_rows: int = 50_000_000) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of docs(doc_id, text); ``n_lines`` counts before dropping.  ``batches`` is 6 or more, of
    about ``batch_rows`` rows at most, unless given."""
    spark = docs.sparkSession
    bounds = _bounds(docs, batches, batch_rows)
    batch = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        batch = F.when(F.col("doc_id") > bounds[i], F.lit(i)).otherwise(batch)
    path = shared_folder(spark, "lines")
    lines(docs, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    found = spark.read.schema(f"{LINES}, batch int").parquet(path)
    keys = frequent(found, bounds, least_docs)
    gone = found.join(keys, "key").filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).select("doc_id", "doc_key", "key", "places")
    gone = gone.dropDuplicates(["doc_id", "doc_key", "key"])  # repeated rows
    gone = gone.groupBy("doc_id", "doc_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "doc_key": "_key"})
    rows = _rows(docs)
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")), "left")
    return _without(both.select("doc_id", "text", "places"))
