"""Tables of the experiments: genome-wide traces, annotations, codes, alignments, arrays, and folders of files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import coordinate
from quillspan.sources.files import measured

# The typed columns of the annotation tables; all others are text.
KINDS = {
    "regions": {"start": "long", "end": "long"},
    "chip": {"start": "long", "end": "long", "fold": "double", "midpoint": "double"},
    "rna": {"start": "long", "end": "long", "midpoint": "double"},
    "genes": {"start": "long", "end": "long", "TSS_position": "long", "midpoint": "double"},
}


def file_rows(raw: DataFrame) -> DataFrame:
    """The rows of a file scan with ``row``, their number in the order of file, block and line.  Blocks are counted first (one row each),
    so files are read in parallel and no row goes through one task."""
    keyed = raw.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    blocks = keyed.groupBy("_f", "_b").agg(F.min("_m").alias("_lo"), F.count("*").alias("_n"))
    first = blocks.select("_f", "_b", "_lo", (F.sum("_n").over(W.orderBy("_f", "_b")) - F.col("_n")).alias("_s"))
    return keyed.join(F.broadcast(first), ["_f", "_b"]).withColumn("row", F.col("_s") + F.col("_m") - F.col("_lo")).drop("_f", "_b", "_m", "_lo", "_s")


def read_genome_traces(spark: SparkSession, path: str, loci: int, landmarks: list[str] = ()) -> DataFrame:
    """Genome-wide trace table (tab separated): cell, copy and locus from the row's number (``loci`` rows of copy 0, then of copy 1, for each
    cell), z, x, y, chr, start, end, genes and states (lists at columns 7 and 8, if there) and the last columns as landmarks."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    names = [f"c{i}" for i in range(len(raw.columns))]
    rows = file_rows(raw).toDF(*names, "row")
    chrom, start, end, _ = coordinate(F.col("c3"))
    more = [F.when(F.col(f"c{i}").isNotNull(), F.split(f"c{i}", ",")).alias(n) for i, n in ((7, "genes"), (8, "states")) if i < len(names) - len(landmarks)]
    marks = [measured(F.col(names[len(names) - len(landmarks) + i])).alias(n) for i, n in enumerate(landmarks)]
    cell, copy = F.floor(F.col("row") / (2 * loci)), F.floor(F.col("row") / loci) % 2
    return rows.select(cell.alias("cell"), copy.alias("copy"), (F.col("row") % loci).alias("locus"), *[measured(F.col(f"c{i}")).alias(c) for i, c in enumerate("zxy")], chrom.alias("chr"), start.alias("start"), end.alias("end"), *more, *marks)


def read_annotation(spark: SparkSession, path: str, kind: str, sep: str = ",") -> DataFrame:
    """Region positions, ChIP peaks, RNA or gene tables with a header; numbers by KINDS, and an ``id`` from the first column of all but
    peaks."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    types = KINDS[kind]
    first = raw.columns[0]
    keep = [F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.trim(f"`{c}`").alias(c) for c in raw.columns if kind == "chip" or c != first]
    return raw.select(*([] if kind == "chip" else [F.col(f"`{first}`").try_cast("long").alias("id")]), *keep)


def read_typed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of cells, long: row, column (both from 0), text and number (null if it is none)."""
    rows = file_rows(spark.read.text(path)).filter(F.trim("value") != "")
    cells = rows.select("row", F.posexplode(F.split("value", sep)).alias("column", "text"))
    return cells.select("row", "column", F.trim("text").alias("text"), F.trim("text").try_cast("double").alias("number"))


def read_encoding(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Encoding scheme: color, group, hyb (place in its group), name, region (place) and code, -1 for blanks; groups of a color that are
    all blank are left out.  Its size rows (num_hyb, num_reg, num_color) may stand anywhere."""
    cells = read_typed(spark, path, sep)
    head = cells.filter("row = 0 and column > 0").select("column", F.col("text").alias("color"))
    names = cells.filter("row > 0 and column = 0").select("row", F.col("text").alias("name"))
    size = lambda n: F.max(F.when((F.col("name") == n) & (F.col("column") == 1), F.col("number"))).cast("int").alias(n)
    body = cells.filter("column > 0").join(names, "row")
    sizes = body.agg(*[size(n) for n in ("num_hyb", "num_reg", "num_color")])
    order = W.orderBy("row")  # the rows of one small file
    hybs = names.filter(~F.col("name").isin("num_hyb", "num_reg", "num_color")).withColumn("_h", F.row_number().over(order) - 1)
    placed = body.drop("name").join(hybs, "row").join(F.broadcast(sizes)).join(head, "column").filter("column <= num_reg * num_color")
    out = placed.select("color", F.floor(F.col("_h") / F.col("num_hyb")).alias("group"), (F.col("_h") % F.col("num_hyb")).alias("hyb"), "name", ((F.col("column") - 1) % F.col("num_reg")).alias("region"), F.coalesce(F.col("number").cast("int"), F.lit(-1)).alias("code"))
    return out.withColumn("_m", F.max("code").over(W.partitionBy("color", "group"))).filter("_m > -1").drop("_m")


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """Codebook table with a header: code (first column) and its readouts r1, r2 (``3--17`` in the fourth), the lesser first."""
    raw = spark.read.option("header", True).csv(path)
    parts = F.transform(F.split(F.col(f"`{raw.columns[3]}`"), "--"), lambda x: F.trim(x).cast("int"))
    return raw.select(F.replace(F.col(f"`{raw.columns[0]}`"), F.lit("__"), F.lit("_")).alias("code"), F.array_min(parts).alias("r1"), F.array_max(parts).alias("r2"))


def codebook_of_names(records: DataFrame, name: str) -> DataFrame:
    """Codes of probe names that hold ``_ChrTAD<code>__ .. _iP<n>__ .. _iR<n>__``: code and the readouts P and R, numbered from 1."""
    part = lambda tag: F.regexp_extract(F.col(name), f"_{tag}(.*?)(?:__|$)", 1)
    good = records.filter(F.col(name).contains("ChrTAD"))
    return good.select(part("ChrTAD").alias("code"), F.concat(F.lit("P"), part("iP").cast("int") + 1).alias("p"), F.concat(F.lit("R"), part("iR").cast("int") + 1).alias("r")).distinct()


def list_files(spark: SparkSession, path: str, pattern: str = "*", number: str = "([0-9]+)") -> DataFrame:
    """path, name, bytes and the first number in the name of the files below a folder, in order of number and name; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.col("length").alias("bytes"))
    return out.withColumn("number", F.nullif(F.regexp_extract("name", number, 1), F.lit("")).cast("long")).orderBy(F.asc_nulls_last("number"), "name")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Numeric ``.npy`` files, long: path, place (flat, from 0), shape and value.  A file is a task's, its rows leave in pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_buffer().to_pybytes()), allow_pickle=False)
                flat = a.ravel().astype(float)
                for low in range(0, len(flat), 1 << 16):
                    part = flat[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(low, low + len(part))), pa.array([list(a.shape)] * len(part), pa.list_(pa.int64())), pa.array(part)], ["path", "place", "shape", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(work, "path string, place long, shape array<long>, value double")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment reports (XML): query, hit, score and length of every high-scoring pair."""
    hsp = "array<struct<Hsp_score:double,`Hsp_align-len`:long>>"
    hit = f"array<struct<Hit_def:string,Hit_hsps:struct<Hsp:{hsp}>>>"
    raw = spark.read.format("xml").option("rowTag", "Iteration").schema(f"`Iteration_query-def` string, Iteration_hits struct<Hit:{hit}>").load(path)
    hits = raw.select(F.col("`Iteration_query-def`").alias("query"), F.explode("Iteration_hits.Hit").alias("h"))
    return hits.select("query", F.col("h.Hit_def").alias("hit"), F.explode("h.Hit_hsps.Hsp").alias("p")).select("query", "hit", F.col("p.Hsp_score").alias("score"), F.col("p.`Hsp_align-len`").alias("length"))


def alignment_counts(pairs: DataFrame, hard: int = 30, soft: int = 17) -> DataFrame:
    """By query: pairs whose length and score reach the hard and the soft bound."""
    reach = lambda n: F.count_if((F.col("length") >= n) & (F.col("score") >= n))
    return pairs.groupBy("query").agg(reach(hard).alias("hard"), reach(soft).alias("soft"))


def write_report(rows: DataFrame, path: str) -> None:
    """A table with a header as CSV."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_shards(rows: DataFrame, path: str, by: str) -> None:
    """One folder for each value; writing again replaces only the values that are written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
