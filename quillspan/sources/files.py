"""Reading and writing of the formats that the experiments use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspan.functions.columns import coordinate


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir; under a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written to a shared folder and read again."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(c: Column) -> Column:
    """A number, null where the text is empty, nan or no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace table (tab separated, ``|`` quotes): trace, chr, start, end, z, x, y and the optional gene columns."""
    raw = spark.read.option("sep", "\t").option("quote", "|").option("header", True).csv(path)
    chrom, start, end, _ = coordinate(F.col("`Genomic coordinate`"))
    more = {"Gene names": "genes", "Transcription": "states", "TSS ZXY(nm)": "tss", "Cell cycle state": "cycle"}
    return raw.select(F.col("`Chromosome copy number`").cast("long").alias("trace"), chrom.alias("chr"), start.alias("start"), end.alias("end"), *[measured(F.col(f"`{c}(nm)`")).alias(c.lower()) for c in "ZXY"], *[F.col(f"`{c}`").alias(n) for c, n in more.items() if c in raw.columns])


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header row and a header column, long: i, j (names) and value."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    first, *rest = raw.columns
    return raw.withColumnRenamed(first, "i").unpivot("i", rest, "j", "value").withColumn("value", measured(F.col("value")))


def read_intervals(spark: SparkSession, path: str, kind: str = "bed") -> DataFrame:
    """BED or tagAlign (count in the fourth later column) and WIG-like rows (count in the fourth): chr, start, end, count."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & ~F.col("value").startswith("track") & (F.trim("value") != "")).select(parts.alias("p"))
    count = F.get("p", F.lit(4 if kind in ("bed", "tagalign") else 3)).try_cast("double")
    return rows.select(F.col("p")[0].alias("chr"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end"), count.alias("count"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region list with a column Region of ``chr:start-stop``."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    chrom, start, end, mid = coordinate(F.col("Region"))
    return raw.select("Region", chrom.alias("chr"), start.alias("start"), end.alias("end"), mid.alias("mid"))


def read_color_usage(spark: SparkSession, path: str) -> DataFrame:
    """Ragged table of rounds: hyb, channel position and what it shows (blank cells dropped)."""
    rows = spark.read.text(path).select(F.split("value", "[,\\t]").alias("p")).filter(F.size("p") > 1)
    cells = rows.select(F.trim(F.col("p")[0]).alias("hyb"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("channel", "content"))
    return cells.select("hyb", "channel", F.trim("content").alias("content")).filter("content <> '' and lower(hyb) <> 'hyb'")


def write_fasta(rows: DataFrame, path: str, name: str, sequence: str) -> None:
    rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)


def combine_fasta(spark: SparkSession, paths: list[str], path: str) -> None:
    """The records of several FASTA files as one folder of them."""
    rows = None
    for one in paths:
        found = read_fasta(spark, one).select("name", "sequence")
        rows = found if rows is None else rows.unionByName(found)
    write_fasta(rows, path, "name", "sequence")


def shows(usage: DataFrame, marker: str) -> DataFrame:
    """Where the color usage names a marker (beads, DAPI; in any case): hyb and channel."""
    return usage.filter(F.lower("content") == marker.lower()).select("hyb", "channel")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Rows of both by key; the existing row of a key stays unless ``overwrite``."""
    first, second = (new, existing) if overwrite else (existing, new)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.upper = options["path"], options.get("upper", "false") == "true"

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        if system.get_file_info(path).type == fs.FileType.Directory:
            return [_Path(x.path) for x in system.get_file_info(fs.FileSelector(path)) if not x.base_name.startswith(("_", "."))]
        return [_Path(path)]

    def read(self, partition: _Path) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        rows: list[tuple] = []
        name, parts, ordinal = None, [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["ordinal", "name", "sequence"])
            rows.clear()
            return out

        def end() -> None:
            nonlocal ordinal
            if name is not None:
                text = "".join(parts)
                rows.append((ordinal, name, text.upper() if self.upper else text))
                ordinal += 1

        import io

        with io.TextIOWrapper(system.open_input_file(partition.path), encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if line.startswith(">"):
                    end()
                    name, parts = line[1:].strip(), []
                    if len(rows) >= 1000:
                        yield batch()
                elif line:
                    parts.append(line)
        end()
        if rows:
            yield batch()


class Fasta(DataSource):
    """``spark.read.format("fasta").load(path)``: ordinal in its file, name and the joined sequence; a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "ordinal long, name string, sequence string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    spark.dataSource.register(Fasta)
    return spark.read.format("fasta").option("upper", str(upper).lower()).load(path)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their number in the group."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their number (from 0) in the order of the whole table: sorted by ranges, written, and numbered from the counts of the ranges
    before (one row a task), so no task sees the whole table.  The order should have no ties."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    kept = written(ranged)
    counts = kept.groupBy("_p").agg(F.min("_m").alias("_lo"), F.count("*").alias("_n"))
    first = counts.select("_p", "_lo", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_s"))
    return kept.join(F.broadcast(first), "_p").withColumn(name, F.col("_s") + F.col("_m") - F.col("_lo")).drop("_p", "_m", "_lo", "_s")
