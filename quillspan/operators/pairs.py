"""Pairs within a trace, and maps of them over all traces.

Points are a long table (trace, locus, z, x, y); coordinates are null where a locus was not detected.  Pairs are an equi-join on
the trace with locus_i < locus_j, so they are spread by trace and no matrix is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance

XYZ = ["z", "x", "y"]


def pair_distances(points: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """trace, i, j, dist for i < j, with the extra columns of both ends as name_i and name_j; dist is null if an end is."""
    extra = extra or []
    side = lambda s: points.select("trace", F.col("locus").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in [*XYZ, *extra]])
    both = side("i").join(side("j"), "trace").filter("i < j")
    dist = distance([F.col(f"{c}_i") for c in XYZ], [F.col(f"{c}_j") for c in XYZ])
    return both.select("trace", "i", "j", dist.alias("dist"), *[f"{c}_{s}" for c in extra for s in "ij"])


def median_map(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("i", "j").agg(F.median("dist").alias("median_dist"))


def mean_map(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("i", "j").agg(F.avg("dist").alias("mean_dist"), F.count("dist").alias("n"))


def contact_map(pairs: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Share of measured distances below each cutoff (strictly), all cutoffs in one aggregation; columns p_<n-th>."""
    n = F.count("dist")
    return pairs.groupBy("i", "j").agg(*[F.try_divide(F.count_if(F.col("dist") < c).cast("double"), n).alias(f"p_{k}") for k, c in enumerate(cutoffs)], n.alias("n"))


def contact_map_without_ties(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Share below the cutoff of those below or above it."""
    below, above = F.count_if(F.col("dist") < cutoff), F.count_if(F.col("dist") > cutoff)
    return pairs.groupBy("i", "j").agg(F.try_divide(below.cast("double"), below + above).alias("p"))


def failure_rate(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(F.avg(F.col("z").isNull().cast("double")).alias("failure"))


def covered(points: DataFrame, most_lost: float) -> DataFrame:
    """The points of traces that lost no more than the given share."""
    good = failure_rate(points, "trace").filter(F.col("failure") <= most_lost).select("trace")
    return points.join(good, "trace", "left_semi")


def decay_by_class(pairs: DataFrame, cls_i: Column, cls_j: Column, span: int, cutoff: float) -> DataFrame:
    """By unordered class pair and separation bin: pairs measured and the share below the cutoff."""
    cls = F.concat(F.least(cls_i, cls_j), F.greatest(cls_i, cls_j))
    bin_ = F.floor((F.col("j") - F.col("i")) / span).cast("long")
    return pairs.groupBy(cls.alias("class"), bin_.alias("bin")).agg(F.count("dist").alias("n"), F.try_divide(F.count_if(F.col("dist") < cutoff).cast("double"), F.count("dist")).alias("p"))


def block_centered(pairs: DataFrame, block: list[str]) -> DataFrame:
    """ln(dist) less its median over the block."""
    value = F.when(F.col("dist") > 0, F.ln("dist"))
    return pairs.withColumn("log_dist", value).withColumn("centered", F.col("log_dist") - F.median("log_dist").over(W.partitionBy(*block)))


def without_cis(pairs: DataFrame) -> DataFrame:
    """Pairs of one chromosome and homolog removed; needs chr_i, chr_j, homolog_i, homolog_j."""
    return pairs.filter("not (chr_i = chr_j and homolog_i = homolog_j)")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin; bins are half-open but for the last, which is closed; values outside are dropped."""
    x = F.col(column)
    bin_ = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return values.filter((x >= low) & (x <= high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of unordered pairs of bins as a symmetric table; pairs of one bin count twice, as both orders do."""
    one = pairs.select(a.alias("bin_i"), b.alias("bin_j"))
    return one.unionByName(one.select(F.col("bin_j").alias("bin_i"), F.col("bin_i").alias("bin_j"))).groupBy("bin_i", "bin_j").agg(F.count("*").alias("n"))


def correlation_matrix(values: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pearson correlation of each two rows over the columns where both are measured."""
    v = values.filter(F.col(value).isNotNull()).select(row, column, value)
    a, b = (v.select(F.col(row).alias(s), column, F.col(value).alias(f"v{s}")) for s in "ij")
    return a.join(b, column).filter("i < j").groupBy("i", "j").agg(F.corr("vi", "vj").alias("r"))


def called_ratio_2d(pairs: DataFrame, a: Column, b: Column, called: Column) -> DataFrame:
    """Called and all measured pairs by bins of both ends, counted in both orders, and their ratio."""
    ends = F.explode(F.array(F.struct(a.alias("x"), b.alias("y")), F.struct(b.alias("x"), a.alias("y"))))
    rows = pairs.select(ends.alias("_e"), called.alias("_c"), "dist")
    n = rows.groupBy(F.col("_e.x").alias("bin_i"), F.col("_e.y").alias("bin_j")).agg(F.count_if("_c").alias("called"), F.count("dist").alias("n"))
    return n.withColumn("ratio", F.try_divide(F.col("called").cast("double"), F.col("n")))


def maps_by_state(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Median map of the traces of each state."""
    return pairs.join(state, "trace").groupBy("state", "i", "j").agg(F.median("dist").alias("median_dist"))


def nearest_copies(points: DataFrame, cell: str, copy: str) -> DataFrame:
    """cell, i < j and the least distance of the two loci over all pairs of the cell's copies."""
    good = points.dropna(subset=XYZ)
    side = lambda s: good.select(cell, F.col("locus").alias(s), F.col(copy).alias(f"_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in XYZ])
    both = side("i").join(side("j"), cell).filter("i < j")
    return both.groupBy(cell, "i", "j").agg(F.min(distance([F.col(f"{c}_i") for c in XYZ], [F.col(f"{c}_j") for c in XYZ])).alias("dist"))
