"""Operators along an ordered sequence of loci.  Windows are per trace; frames are bounded wherever the semantics are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance, effect_of, ks_of, mean_of, median_of

XYZ = ["z", "x", "y"]


def _w(by: str = "trace", order: str = "locus"):
    return W.partitionBy(by).orderBy(order)


def neighbor_distance(points: DataFrame, step: int = 1) -> DataFrame:
    """Distance to the locus ``step`` on; null if that locus is not in the table."""
    there = F.lead("locus", step).over(_w()) == F.col("locus") + step
    d = distance([F.col(c) for c in XYZ], [F.lead(c, step).over(_w()) for c in XYZ])
    return points.withColumn("neighbor_dist", F.when(there, d))


def local_distance(points: DataFrame, reach: int) -> DataFrame:
    """Distance from the mean of the loci within ``reach``, itself excluded."""
    w = _w().rangeBetween(-reach, reach)
    others = [(F.sum(c).over(w) - F.coalesce(F.col(c), F.lit(0.0))) / F.nullif(F.count(c).over(w) - F.col(c).isNotNull().cast("int"), F.lit(0)) for c in XYZ]
    return points.withColumn("local_dist", distance([F.col(c) for c in XYZ], others))


def centroid_shift(points: DataFrame, width: int) -> DataFrame:
    """Distance between the centroids of the ``width`` rows before and the ``width`` from here on."""
    before, after = _w().rowsBetween(-width, -1), _w().rowsBetween(0, width - 1)
    return points.withColumn("shift", distance([F.avg(c).over(before) for c in XYZ], [F.avg(c).over(after) for c in XYZ]))


def boundary_score(pairs: DataFrame, loci: DataFrame, width: int, metric: str = "median") -> DataFrame:
    """Score of every place c of loci(trace, c): distances across c within [c - width, c + width) against those within the halves.

    median, mean: difference of the middles over the root of the summed spreads (see effect_of); ks: signed Kolmogorov-Smirnov
    statistic; insulation: mean across over mean within; normed_insulation: (within - across) / (within + across).  Distances of 0
    within a half do not count.  Places less than half a width from an end, or without distances on a side, have 0; null where a
    spread is 0.  Each pair is dealt only to the places whose window holds it, so the cost is linear in the band."""
    near = pairs.filter((F.col("j") - F.col("i") < 2 * width) & F.col("dist").isNotNull())
    dealt = near.withColumn("c", F.explode(F.sequence(F.col("j") - width + 1, F.col("i") + width)))
    across = (F.col("i") < F.col("c")) & (F.col("j") >= F.col("c"))
    lists = dealt.groupBy("trace", "c").agg(F.collect_list(F.when(across, F.col("dist"))).alias("_b"), F.collect_list(F.when(~across & (F.col("dist") > 0), F.col("dist"))).alias("_w"))
    b, w = F.col("_b"), F.col("_w")
    score = {
        "median": lambda: effect_of(b, w, median_of),
        "mean": lambda: effect_of(b, w, mean_of),
        "ks": lambda: ks_of(b, w),
        "insulation": lambda: F.try_divide(mean_of(b), mean_of(w)),
        "normed_insulation": lambda: F.try_divide(mean_of(w) - mean_of(b), mean_of(w) + mean_of(b)),
    }[metric]()
    n = F.max("c").over(W.partitionBy("trace")) + 1
    placed = loci.select("trace", "c").distinct().withColumn("_n", n).join(lists, ["trace", "c"], "left")
    end = (F.col("c") < width // 2) | (F.col("c") + width // 2 >= F.col("_n"))
    none = F.coalesce((F.size("_b") < 1) | (F.size("_w") < 1), F.lit(True))
    return placed.select("trace", "c", F.when(end | none, F.lit(0.0)).otherwise(score).alias("score"))


def valley_maxima(rows: DataFrame, value: str, reach: int, cutoff: float) -> DataFrame:
    """Rows above the cutoff that are the greatest of [here - reach, here + reach)."""
    top = F.max(value).over(_w().rowsBetween(-reach, reach - 1))
    return rows.withColumn("_top", top).filter((F.col(value) == F.col("_top")) & (F.col(value) > cutoff)).drop("_top")


def runs(rows: DataFrame, by: str, order: list[str], label: Column) -> DataFrame:
    """Maximal runs of equal labels: by, run number, label, first and length (nulls are a label)."""
    w = W.partitionBy(by).orderBy(*order)
    r = rows.withColumn("_l", label).withColumn("_p", F.lag("_l").over(w)).withColumn("_n", F.row_number().over(w))
    r = r.withColumn("run", F.sum(F.when((F.col("_n") == 1) | ~F.col("_l").eqNullSafe(F.col("_p")), 1).otherwise(0)).over(w))
    return r.groupBy(by, "run").agg(F.first("_l").alias("label"), F.min("_n").cast("long").alias("first"), F.count("*").alias("length"))


def interpolated(rows: DataFrame, value: str, by: str = "trace", order: str = "locus") -> DataFrame:
    """Nulls filled linearly between the nearest measured rows; beyond the ends, by the nearest one."""
    back, on = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    p, n = F.last(known, True).over(back), F.first(known, True).over(on)
    r = rows.withColumn("_p", p).withColumn("_n", n)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(order) - F.col("_p.at")) / F.nullif(F.col("_n.at") - F.col("_p.at"), F.lit(0))
    return r.withColumn("filled", F.coalesce(F.col(value), line, F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")


def loop_outs(points: DataFrame, threshold: float) -> DataFrame:
    """Flags loci both of whose steps are at least the threshold."""
    here = [F.col(c) for c in XYZ]
    before, after = distance(here, [F.lag(c).over(_w()) for c in XYZ]), distance(here, [F.lead(c).over(_w()) for c in XYZ])
    return points.withColumn("loop_out", F.coalesce((before >= threshold) & (after >= threshold), F.lit(False)))


def cumulative_edges(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Where each block begins and ends when blocks are laid end to end.  One task: meant for a table of blocks."""
    w = W.orderBy(order)
    end = F.sum(size).over(w)
    return sizes.withColumn("begin", (end - F.col(size)).cast("long")).withColumn("stop", end.cast("long"))


def shifted(rows: DataFrame, shift: int, by: str = "trace", order: str = "locus", label: str = "label") -> DataFrame:
    """The label of the row ``shift`` places on, in a circle: a control that keeps runs."""
    w = W.partitionBy(by).orderBy(order)
    r = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_c", F.count("*").over(W.partitionBy(by)))
    labels = r.select(F.col(by), F.pmod(F.col("_n") - shift, F.col("_c")).alias("_n"), F.col(label).alias("shifted"))
    return r.drop("_c").join(labels, [by, "_n"]).drop("_n")
