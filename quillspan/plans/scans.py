"""Queries that write a table in a format of the experiments to a shared folder and read it back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.plans.catalog import _SEQ, P, _letters, points, query, r6, table
from quillspan.sources import files, tables
from quillspan.streaming import arrivals


@query(f"WITH {P} SELECT trace // 2 AS cell, trace % 2 AS copy, locus, round(z, 6) AS z, round(x, 6) AS x, round(y, 6) AS y, 'chr' || label AS chr, locus * 100 AS \"start\", locus * 100 + 50 AS \"end\" FROM pts")
def genome_scan(spark, sf):
    """Traces 2n and 2n + 1 as both copies of a cell: the place of a row in the file says whose it is."""
    p = points(spark, sf)
    loci = p.agg(F.max("locus") + 1).first()[0]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)
    rows = p.repartitionByRange("trace", "locus").sortWithinPartitions("trace", "locus").select(text("z"), text("x"), text("y"), F.format_string("chr%d:%d-%d", "label", F.col("locus") * 100, F.col("locus") * 100 + 50).alias("coordinate"))
    path = files.shared_path(spark, "genome")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return tables.read_genome_traces(spark, path, loci).select("cell", "copy", "locus", *r6("z", "x", "y"), "chr", "start", "end")


@query("SELECT p_partkey AS id, p_brand AS chr, (p_partkey * 10)::BIGINT AS \"start\", (p_partkey * 10 + p_size)::BIGINT AS \"end\", (p_partkey * 10 + 1)::BIGINT AS \"TSS_position\", round(p_partkey * 10 + p_size / 2.0, 6) AS midpoint FROM part")
def annotation_scan(spark, sf):
    k = F.col("p_partkey") * 10
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chr"), k.alias("start"), (k + F.col("p_size")).alias("end"), (k + 1).alias("TSS_position"), (k + F.col("p_size") / 2.0).alias("midpoint"))
    path = files.shared_path(spark, "genes")
    tables.write_report(rows, path)
    return tables.read_annotation(spark, path, "genes").withColumn("midpoint", F.round("midpoint", 6))


@query(f"SELECT 'item' || item_id AS name, {_SEQ} AS sequence FROM benchmark")
def fasta_scan(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("name"), _letters().alias("sequence"))
    path = files.shared_path(spark, "fasta")
    files.write_fasta(rows, path, "name", "sequence")
    return files.read_fasta(spark, path).select("name", "sequence")


@query("SELECT 'chr' || (p_partkey % 23) AS chr, (p_partkey * 10)::BIGINT AS \"start\", (p_partkey * 10 + p_size)::BIGINT AS \"end\", p_retailprice::DOUBLE AS count FROM part")
def interval_scan(spark, sf):
    line = F.format_string("chr%d\t%d\t%d\tname\t%s", F.col("p_partkey") % 23, F.col("p_partkey") * 10, F.col("p_partkey") * 10 + F.col("p_size"), F.col("p_retailprice").cast("string"))
    path = files.shared_path(spark, "bed")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return files.read_intervals(spark, path).select("chr", "start", "end", "count")


@query("SELECT s_suppkey AS i, c_nationkey AS j, count(*)::DOUBLE AS value FROM supplier JOIN customer ON c_custkey % 10 = s_suppkey % 10 GROUP BY 1, 2".replace("s_suppkey AS i, c_nationkey AS j", "s_suppkey::VARCHAR AS i, c_nationkey::VARCHAR AS j"))
def matrix_scan(spark, sf):
    """A matrix with a header row and column, written wide and read long; empty cells are left out."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).alias("k"))
    c = table(spark, sf, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 10).alias("k")).agg(F.count("*").alias("n"))
    names = [r[0] for r in c.select("c_nationkey").distinct().orderBy("c_nationkey").collect()]
    wide = s.join(c, "k").groupBy("s_suppkey").pivot("c_nationkey", names).agg(F.sum("n"))
    path = files.shared_path(spark, "matrix")
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return files.read_matrix(spark, path).filter("value is not null")


@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS rate FROM events GROUP BY 1, 2")
def stream_rates(spark, sf):
    """The events as a stream, worked off: rates by hour and type."""
    scan = table(spark, sf, "events")
    stream = arrivals.arriving(spark, f"{sf.rstrip('/')}/[e]vents.parquet", scan.schema).select("ts", "event_type", "value")
    rates = arrivals.rates(stream, "ts", ["event_type"], F.col("value") > 50, "1 hour", "1 day")
    done = arrivals.finish(rates, files.shared_path(spark, "rates"), files.shared_path(spark, "rates-checkpoint"), ["begin", "event_type"])
    return done.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", *r6("rate"))
