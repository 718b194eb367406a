"""Pairs of probes along genes, and readouts that share no word with another: choices that depend on earlier ones.

What each place or candidate is worth is DataFrame work.  The greedy scan along a gene is a grouped-map function over the places
that passed (numbers only); the choice among all readouts is made in rounds over shared words, each an aggregation and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import kmers, reverse_complement, share_of
from quillspan.operators.codes import good_readout
from quillspan.operators.decode import tile
from quillspan.operators.sequences import kmer_rows


def weighted_kmers(rows: DataFrame, id_: str, sequence: Column, k: int, weight: Column) -> DataFrame:
    """k-mer and the sum of its sequences' weights over its occurrences (sequences of k letters or fewer do not count)."""
    rows = rows.filter(F.length(sequence) > k).select(F.col(id_), sequence.alias("_q"), weight.cast("double").alias("_w"))
    words = rows.withColumn("kmer", F.explode(F.transform(kmers(F.col("_q"), k), lambda x: x)))
    return words.groupBy("kmer").agg(F.sum("_w").alias("n"))


def _places(probes: DataFrame, counts: DataFrame, length: int, k: int, by: list[str]) -> DataFrame:
    """gene, place, by.. and the sum n of counts(kmer, by.., n) over the words of the probe at each place; probes without a hit are left out."""
    words = probes.select("gene", F.posexplode(kmers(F.col("sequence"), k)).alias("at", "kmer"))
    hits = words.join(counts.select("kmer", *by, "n"), "kmer")
    last = F.greatest(F.col("at") - (length - k), F.lit(0))
    spread = hits.withColumn("place", F.explode(F.sequence(last.cast("long"), F.col("at").cast("long"))))
    return spread.groupBy("gene", "place", *by).agg(F.sum("n").alias("n"))


def pair_candidates(
    genes: DataFrame,
    length: int = 30,
    k: int = 17,
    gc: tuple[float, float] = (0.3, 0.7),
    repeats: DataFrame | None = None,
    background: DataFrame | None = None,
    most: tuple[float, float] = (2, 10),
    index: DataFrame | None = None,
    apart: tuple[float, float] = (3, 5),
) -> DataFrame:
    """gene, place and the two probes of ``length`` letters that stand side by side there, where they pass.

    Neither has an N or a GC share outside the range (ends allowed), nor a word of ``repeats`` (kmer, n).  Of their sums over ``background`` (kmer, n) the smaller
    is below the smaller of ``most`` and the greater below the greater.  ``index`` (kmer, other, n) counts words by gene: of each probe's
    sums the greatest (ties: least gene) is its own; there must be no other gene in which one probe has more than the first of ``apart`` and the other more than the
    second, or else none the other way round."""
    sides = genes.select("gene", F.posexplode(kmers(F.col("sequence"), length)).alias("place", "probe")).select("gene", F.col("place").cast("long").alias("place"), "probe")
    share = share_of(F.col("probe"))
    fit = sides.filter(~F.col("probe").contains("N") & (share >= gc[0]) & (share <= gc[1]))
    if repeats is not None:
        fit = fit.join(_places(genes, repeats.filter("n <> 0"), length, k, []), ["gene", "place"], "left_anti")
    if background is not None:
        fit = fit.join(_places(genes, background, length, k, []).withColumnRenamed("n", "score"), ["gene", "place"], "left")
    else:
        fit = fit.withColumn("score", F.lit(None).cast("double"))
    score = F.coalesce("score", F.lit(0.0))
    left = fit.select("gene", "place", F.col("probe").alias("first"), score.alias("s1"))
    right = fit.select("gene", (F.col("place") - length).alias("place"), F.col("probe").alias("second"), score.alias("s2"))
    both = left.join(right, ["gene", "place"])
    if background is not None:
        both = both.filter((F.least("s1", "s2") < min(most)) & (F.greatest("s1", "s2") < max(most)))
    if index is not None:
        sums = _places(genes, index, length, k, ["other"])
        others = sums.withColumn("_r", F.row_number().over(W.partitionBy("gene", "place").orderBy(F.desc("n"), "other"))).filter("_r > 1").drop("_r")
        shared = others.join(others.select("gene", (F.col("place") - length).alias("place"), "other", F.col("n").alias("m")), ["gene", "place", "other"])
        one, two = (F.col("n") > apart[0]) & (F.col("m") > apart[1]), (F.col("m") > apart[0]) & (F.col("n") > apart[1])
        bad = shared.groupBy("gene", "place").agg(F.bool_or(one).alias("one"), F.bool_or(two).alias("two")).filter("one and two")
        both = both.join(bad, ["gene", "place"], "left_anti")
    return both.select("gene", "place", "first", "second")


def pair_probes(genes: DataFrame, length: int = 30, **rules) -> DataFrame:
    """gene, pair, member, place and probe.  Along each gene a pair that passes uses up its first probe's letters, so the next one begins there
    or later; a pair that begins with the second probe of the last one goes on with that pair's numbers.  ``rules`` as in ``pair_candidates``."""
    found = pair_candidates(genes, length, **rules)
    kept = tile(found, "gene", "place", length, 0)
    w = W.partitionBy("gene").orderBy("place")
    goes_on = F.coalesce(F.col("place") - F.lag("place").over(w) == length, F.lit(False))
    kept = kept.withColumn("goes_on", goes_on).withColumn("pair", F.sum((~F.col("goes_on")).cast("int")).over(w).cast("long"))
    kept = kept.withColumn("step", F.row_number().over(W.partitionBy("gene", "pair").orderBy("place")))
    rows = kept.join(found, ["gene", "place"])
    second = F.struct((F.col("step") + 1).cast("long").alias("member"), (F.col("place") + length).alias("place"), F.col("second").alias("probe"))
    first = F.struct(F.lit(1).cast("long").alias("member"), F.col("place").alias("place"), F.col("first").alias("probe"))
    return rows.select("gene", "pair", F.explode(F.when(F.col("goes_on"), F.array(second)).otherwise(F.array(first, second))).alias("x")).select("gene", "pair", "x.*")


def extended(sequence: Column, seed: Column, length: int, before: bool = True) -> Column:
    """The sequence brought to ``length`` letters by drawn ones: the letter beside it A or T, the others any; the same seed draws the same."""
    n = length - F.length(sequence)
    digits = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))  # 256 hex digits
    drawn = F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT")
    near = F.translate(F.left(digits, F.lit(1)), "0123456789abcdef", "ATATATATATATATAT")
    more = F.concat(near, F.substring(drawn, F.lit(2), n - 1))
    return F.when(n <= 0, F.left(sequence, F.lit(length))).otherwise(F.concat(F.reverse(more), sequence) if before else F.concat(sequence, more))


def words_of(rows: DataFrame, id_: str, sequence: Column, k: int) -> DataFrame:
    """id and each word of k letters, of the word and its reverse complement the lesser."""
    rows = kmer_rows(rows, id_, sequence, k)
    return rows.select(id_, F.least("kmer", reverse_complement(F.col("kmer"))).alias("word")).distinct()


def first_independent(words: DataFrame, order: str = "rank") -> DataFrame:
    """The ranks that a scan in order keeps when it takes every candidate that shares no word with one kept before, of words(rank, word).

    In rounds: who is the least undecided rank of all its words is kept; who shares a word with a kept one is dropped.  A round looks at each
    word once, so a word that very many share makes no pairs; rounds end when none is undecided (each decides at least the least rank)."""
    from quillspan.sources.files import written

    left, kept = written(words.select(F.col(order).alias("rank"), "word").distinct()), []
    while left.limit(1).count():
        least = left.groupBy("word").agg(F.min("rank").alias("least"))
        judged = left.join(least, "word").groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("least")).alias("keeps"))
        now = written(judged.filter("keeps").select("rank"))
        kept.append(now)
        used = left.join(now, "rank", "left_semi").select("word").distinct()
        out = left.join(used, "word", "left_semi").select("rank").distinct()
        left = written(left.join(out, "rank", "left_anti"))
    spark = words.sparkSession
    out = spark.createDataFrame([], f"{order} {dict(words.dtypes)[order]}")
    for now in kept:
        out = out.unionByName(now.withColumnRenamed("rank", order))
    return out


def search_readouts(pool: DataFrame, total: int, length: int = 30, tries: int = 32, k: int = 11, existing: DataFrame | None = None, **rules) -> DataFrame:
    """id, try_ and sequence of the first ``total`` readouts of pool(id, sequence) in the order of id: each extended in ``tries`` ways, in order, and the
    first kept that passes ``codes.good_readout`` and shares no run of k letters, on either strand, with existing(sequence) or one
    kept before.  Ids are distinct and not null.

    What is kept depends on lesser ids alone, so ids are judged in order in parts, each four times as large, until ``total`` are kept or none is left."""
    from quillspan.sources.files import written

    taken = None
    if existing is not None:
        taken = written(words_of(existing.select(F.lit(0).alias("_e"), "sequence"), "_e", F.col("sequence"), k).select("word").distinct())
    out, n, rest, size = None, 0, pool, 8 * total
    while out is None or n < total:
        last = rest.select("id").orderBy("id").limit(size).agg(F.max("id")).first()[0]
        if last is None and out is not None:
            break
        part = rest.filter(F.col("id") <= F.lit(last))
        made = part.withColumn("try_", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("sequence", extended(F.col("sequence"), F.concat_ws(":", F.col("id").cast("string"), F.col("try_").cast("string")), length))
        good = written(made.filter(good_readout(F.col("sequence"), **rules)).withColumn("rank", F.struct("id", "try_")).select("rank", "sequence"))
        words = words_of(good, "rank", F.col("sequence"), k)
        if taken is not None:
            words = words.join(words.join(taken, "word", "left_semi").select("rank").distinct(), "rank", "left_anti")
        own = words.select("rank", F.concat(F.lit("of "), F.col("rank.id").cast("string")).alias("word")).distinct()  # one try of each
        found = written(good.join(first_independent(words.unionByName(own)), "rank"))
        used = words_of(found, "rank", F.col("sequence"), k).select("word")
        taken = used if taken is None else taken.unionByName(used)
        out, n = found if out is None else out.unionByName(found), n + found.count()
        rest, size = rest.filter(F.col("id") > F.lit(last)), 4 * size
    return out.orderBy("rank").limit(total).select("rank.id", "rank.try_", "sequence")
