"""k-mer tables, off-target hits and probe choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import kmer_words, kmers, reverse_complement


def kmer_rows(rows: DataFrame, id_: str, sequence: Column, k: int) -> DataFrame:
    """One row for each k-mer of each sequence (a null sequence has none)."""
    return rows.select(id_, sequence.alias("_s")).select(id_, F.explode(kmer_words(F.col("_s"), k)).alias("kmer"))


def kmer_counts(rows: DataFrame, id_: str, sequence: Column, k: int, most: int = 65535) -> DataFrame:
    """Occurrences of each k-mer, saturating."""
    return kmer_rows(rows, id_, sequence, k).groupBy("kmer").agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("n"))


def kmer_counts_of(rows: DataFrame, id_: str, sequence: Column, k: int, wanted: DataFrame, most: int = 65535) -> DataFrame:
    """kmer_counts of the wanted k-mers (kmer, distinct) only: the others leave before the shuffle where the list is small enough to be
    broadcast (Spark checks its size), else by a semi-join."""
    return kmer_rows(rows, id_, sequence, k).join(wanted, "kmer", "left_semi").groupBy("kmer").agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("n"))


def off_target_hits(probes: DataFrame, counts: DataFrame, id_: str, sequence: Column, k: int, both_strands: bool = False) -> DataFrame:
    """Sum of the counts of each probe's k-mers.  Repeated k-mers of a probe are looked up once and weighted, so the join carries one
    row for each probe and distinct k-mer."""
    words = kmer_rows(probes, id_, sequence, k)
    if both_strands:
        words = words.unionByName(words.withColumn("kmer", reverse_complement(F.col("kmer"))))
    words = words.groupBy(id_, "kmer").agg(F.count("*").alias("times"))
    hits = words.join(counts, "kmer", "left").groupBy(id_).agg(F.sum(F.col("times") * F.coalesce("n", F.lit(0))).cast("long").alias("hits"))
    return probes.select(id_).join(hits, id_, "left").select(id_, F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def screened(probes: DataFrame, counts: DataFrame, id_: str, sequence: Column, k: int, allowed: int) -> DataFrame:
    """Probes with no more than the allowed hits."""
    bad = off_target_hits(probes, counts, id_, sequence, k).filter(F.col("hits") > allowed).select(id_)
    return probes.join(bad, id_, "left_anti")


def similar_pairs(rows: DataFrame, id_: str, sequence: Column, k: int, least: int = 1) -> DataFrame:
    """Pairs i > j by how often the k-mers of i, each as often as i has it, occur in j and in its reverse complement.  Occurrences in
    j do not overlap (as those that str.count counts)."""
    mine = kmer_rows(rows, id_, sequence, k).groupBy(F.col(id_).alias("i"), "kmer").agg(F.count("*").alias("times"))
    both = rows.select(id_, F.posexplode(F.array(sequence, reverse_complement(sequence))).alias("strand", "_s")).filter("_s is not null")
    places = both.select(F.col(id_).alias("j"), "strand", F.posexplode(kmers(F.col("_s"), k)).alias("place", "kmer"))
    at = F.array_sort(F.collect_list("place"))
    start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x >= a["last"] + k, F.struct(x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    theirs = places.groupBy("j", "strand", "kmer").agg(F.aggregate(at, start, step, lambda a: a["n"]).alias("n")).groupBy("j", "kmer").agg(F.sum("n").alias("n"))
    return mine.join(theirs, "kmer").filter("i > j").groupBy("i", "j").agg(F.sum(F.col("times") * F.col("n")).alias("shared")).filter(F.col("shared") >= least)


def inverted_index(rows: DataFrame, id_: str, sequence: Column, k: int) -> DataFrame:
    """k-mer and the sequence ids that have it, as rows (not lists), so that a frequent k-mer stays spread."""
    return kmer_rows(rows, id_, sequence, k).distinct()


def choose(rows: DataFrame, by: list[str], place: str, k: int, how: str = "mid") -> DataFrame:
    """k rows of each group: nearest to the middle of the group's places, or leftmost, or rightmost (ties: least place)."""
    w = W.partitionBy(*by)
    mid = (F.min(place).over(w) + F.max(place).over(w)) / 2
    key = {"mid": F.abs(F.col(place) - mid), "left": F.col(place), "right": -F.col(place)}[how]
    return rows.withColumn("_k", key).withColumn("pick", F.row_number().over(w.orderBy("_k", place))).filter(F.col("pick") <= k).drop("_k")


def unused_pairs(codes: DataFrame, used: DataFrame, most: int | None = None, block: int = 1000, parts: int = 64) -> DataFrame:
    """Pairs a < b of a code table that no one uses: controls for decoding.  More than ``most`` codes are an error, if given.

    Codes are dealt to blocks of about ``block``, or to ``parts`` larger ones where that is fewer, so what is moved grows with the codes.  Of two
    blocks each code of the lower one meets the other one as one array, less those that it is used with, so no pair is shuffled.  Blocks
    are joined by sort-merge: by the size of their files they would be sent to all tasks."""
    kind = dict(codes.dtypes)["code"]
    one = codes.select("code").dropna().distinct()
    n = one.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} codes")
    parts = max(1, min(parts, -(-n // block)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    firsts = one.select(F.col("code").alias("_x"), of("code").alias("_i")).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(parts - 1))))
    blocks = one.groupBy(of("code").alias("_j")).agg(F.collect_list("code").alias("_codes")).select("_j", "_codes", F.explode(F.sequence(F.lit(0), F.col("_j"))).alias("_i"))
    taken = used.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).filter("a < b")
    for c in ("a", "b"):
        taken = taken.join(one.select(F.col("code").alias(c)), c, "left_semi")
    turned = of("a") > of("b")
    x, y = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    taken = taken.select(x.alias("_x"), y.alias("_y")).groupBy("_x", of("_y").alias("_j")).agg(F.collect_set("_y").alias("_used"))
    met = max(1, parts * parts // 8)  # tasks of about four pairs of blocks; by the small sizes that meet they would be joined to a few
    both = firsts.join(taken.hint("merge"), ["_x", "_j"], "left").repartition(met, "_i", "_j").join(blocks.repartition(met, "_i", "_j").hint("merge"), ["_i", "_j"])
    left = F.when(F.col("_used").isNull(), F.col("_codes")).otherwise(F.array_except("_codes", "_used"))
    pairs = both.select("_x", "_i", "_j", F.explode(left).alias("_y")).filter((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    return pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def assembled(rows: DataFrame, parts: list[Column]) -> DataFrame:
    return rows.withColumn("probe", F.concat(*parts))


def fewest_hits(hits: DataFrame, by: list[str], id_: str, k: int) -> DataFrame:
    """The k probes of each region with the fewest hits (ties: least id)."""
    return hits.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("hits", id_))).filter(F.col("_r") <= k).drop("_r")
