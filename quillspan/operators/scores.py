"""Scores of spots: distances and intensities against references, checks and choices."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance
from quillspan.operators.significance import running

XYZ = ["z", "x", "y"]


def linear_distance_score(d: Column, reference: Column, weight: float = 1.0, most: float | None = None, missing: float = -1000.0) -> Column:
    """-weight * d / reference, once more for what is beyond ``most``; the given score where the distance is null."""
    score = -weight * d / reference
    if most is not None:
        score = score - F.when(d > most, weight * (d - most) / reference).otherwise(0.0)
    return F.coalesce(score, F.lit(missing))


def linear_intensity_score(v: Column, reference: Column, weight: float = 1.0, dark: float = -1000.0, missing: float = 0.0) -> Column:
    """weight * ln(v / (v + reference)); ``dark`` for values of 0 or less, ``missing`` for nulls."""
    return F.when(v.isNull(), missing).when(v <= 0, dark).otherwise(weight * F.ln(v / (v + reference)))


def rescaled(cdf: Column, low: Column, high: Column) -> Column:
    """A cdf rescaled so that the cdf ``low`` is 0 and ``high`` is 1, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cdf - low) / F.when(high > low, high - low).otherwise(1.0)))


def cdf_distance_score(rows: DataFrame, by: list[str], value: str, low: float, high: float, weight: float = 1.0, missing: float = -1000.0, none: float = -1000.0) -> DataFrame:
    """weight * ln(1 - cdf) of a distance among the group's distances, the cdf rescaled between low and high; ``none`` where that is minus
    infinity.  Running counts over distinct values."""
    w = W.partitionBy(*by)
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(w)
    cdf = n.select(*by, "_v", (F.sum("_n").over(w.orderBy("_v")) / total).alias("_c"), (F.sum(F.when(F.col("_v") <= low, F.col("_n")).otherwise(0)).over(w) / total).alias("_lo"), (F.sum(F.when(F.col("_v") <= high, F.col("_n")).otherwise(0)).over(w) / total).alias("_hi"))
    keys = [F.col(f"_k{i}") for i in range(len(by))]
    cdf = cdf.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_v", (1 - rescaled(F.col("_c"), F.col("_lo"), F.col("_hi"))).alias("_p"))
    both = rows.join(cdf, [*[F.col(c).eqNullSafe(k) for c, k in zip(by, keys, strict=True)], F.col(value) == F.col("_v")], "left")
    score = F.when(F.col(value).isNull(), missing).when(F.col("_p") > 0, weight * F.ln(F.col("_p"))).otherwise(none)
    return both.withColumn("score", score).drop("_v", "_p", *[f"_k{i}" for i in range(len(by))])


def spot_scores(points: DataFrame, intensity: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), reach: int = 5) -> DataFrame:
    """Sum of linear scores by trace: distance from the trace's centre, distance from the mean of the loci within ``reach``, intensity.
    Each reference is the trace's median of that quantity."""
    w = W.partitionBy("trace")
    centred = points.withColumn("_ct", distance([F.col(c) for c in XYZ], [F.avg(c).over(w) for c in XYZ]))
    near = w.orderBy("locus").rangeBetween(-reach, reach)
    others = [(F.sum(c).over(near) - F.coalesce(F.col(c), F.lit(0.0))) / F.nullif(F.count(c).over(near) - F.col(c).isNotNull().cast("int"), F.lit(0)) for c in XYZ]
    centred = centred.withColumn("_lc", distance([F.col(c) for c in XYZ], others))
    reference = centred.groupBy("trace").agg(*[F.median(c).alias(f"_r{c}") for c in ("_ct", "_lc", intensity)])
    total = linear_distance_score(F.col("_ct"), F.col("_r_ct"), weights[0]) + linear_distance_score(F.col("_lc"), F.col("_r_lc"), weights[1]) + linear_intensity_score(F.col(intensity), F.col(f"_r{intensity}"), weights[2])
    scored = centred.join(reference, "trace").withColumn("score", total).withColumnRenamed("_ct", "centre_dist")
    return scored.drop("_lc", "_r_ct", "_r_lc", f"_r{intensity}")


def checked(scored: DataFrame, by: list[str], picked: str, percent: float, least: float, most: float, values: list[str]) -> DataFrame:
    """Picked rows, their values null where the score is below the greater of ``least`` and the smaller of two percentiles (the picked
    scores' ``percent`` and the others' 100 - ``percent``), or the centre is farther than ``most``."""
    q = scored.groupBy(*by).agg(F.percentile(F.when(F.col(picked), F.col("score")), F.lit(percent / 100)).alias("_s"), F.percentile(F.when(~F.col(picked), F.col("score")), F.lit(1 - percent / 100)).alias("_o"))
    limit = F.greatest(F.least("_s", "_o"), F.lit(least))
    good = F.coalesce((F.col("score") >= limit) & (F.col("centre_dist") <= most), F.lit(False))
    out = scored.filter(F.col(picked)).join(q, by)
    return out.select(*[F.when(good, F.col(c)).alias(c) if c in values else F.col(c) for c in scored.columns])


def greatest_product(rows: DataFrame, keys: list[str], pool: list[str], features: dict[str, bool], tie: str) -> DataFrame:
    """By keys: the row with the greatest product of the pool's cdfs of its features (True: bigger is better)."""
    score = F.lit(1.0)
    for c, bigger in features.items():
        cdf = F.cume_dist().over(W.partitionBy(*pool).orderBy(c))
        score = score * (cdf if bigger else 1 - cdf)
    scored = rows.withColumn("score", score)
    return scored.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("score", 12)), tie))).filter("_r = 1").drop("_r")


def weak_species(rows: DataFrame, channel: str, species: str, value: str, weakest: int, below: float) -> DataFrame:
    """By channel: mean and population deviation of the values below the threshold of the ``weakest`` species by mean value."""
    mean = rows.groupBy(channel, species).agg(F.avg(value).alias("_m"))
    weak = mean.withColumn("_r", F.row_number().over(W.partitionBy(channel).orderBy(F.round("_m", 9), species))).filter(F.col("_r") <= weakest).select(channel, species)
    return rows.join(weak, [channel, species], "left_semi").filter(F.col(value) < below).groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count("*").alias("n"))


def p_value_flags(rows: DataFrame, stats: DataFrame, by: str, value: str, sure: float = 1e-6, unsure: float = 0.01) -> DataFrame:
    """1 where the one-sided normal p of the value is below ``sure``, -1 where it is at least ``unsure``, else 0.  The bounds are turned
    into bounds of the standard score, so no error function is needed."""
    high, low = (NormalDist().inv_cdf(1 - p) for p in (sure, unsure))
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("deviation"))
    return rows.join(stats.select(by, "mean", "deviation"), by).withColumn("flag", F.when(z > high, 1).when(z <= low, -1).when(z.isNull(), None).otherwise(0)).drop("mean", "deviation")


def quantile_rows(rows: DataFrame, by: list[str], value: str, steps: int = 20) -> DataFrame:
    """by, step and the sorted value at place floor(step * n / steps), for each step below ``steps``."""
    placed = running(rows.filter(F.col(value).isNotNull()), by, value, {"n": F.count("*")})
    first = F.ceil((F.col("run_n") - F.col("n")) * steps / F.col("all_n")).cast("int")
    last = F.ceil(F.col("run_n") * steps / F.col("all_n")).cast("int") - 1  # steps whose place is one of this value's
    hit = placed.filter(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    return hit.select(*by, "step", F.col(value).alias(value))


def flattened(rows: DataFrame, by: str, value: str, reference: DataFrame, steps: int = 20) -> DataFrame:
    """The value mapped by the line that best takes the group's quantile rows to those of the reference, as ``flat``."""
    own = quantile_rows(rows, [by], value, steps)
    to = quantile_rows(reference.select(F.lit(0).alias("_one"), value), ["_one"], value, steps).select("step", F.col(value).alias("_to"))
    line = own.join(to, "step").groupBy(by).agg(F.regr_slope("_to", value).alias("_m"), F.regr_intercept("_to", value).alias("_c"))
    return rows.join(line, by).withColumn("flat", F.col(value) * F.col("_m") + F.col("_c")).drop("_m", "_c")


def better_repeat(rows: DataFrame, by: list[str], repeat: str, value: str, least_ratio: float = 0.8) -> DataFrame:
    """by, best: of two repeats 0 and 1 of a round, the one with more spots if the smaller number is below ``least_ratio`` of the greater
    (ties: 0); else 1 if more than half of as many brightest spots, in order, are brighter there, else 0."""
    n = rows.groupBy(*by).agg(F.count_if(F.col(repeat) == 0).alias("_a"), F.count_if(F.col(repeat) == 1).alias("_b"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, repeat).orderBy(F.desc(value))))
    paired = ranked.groupBy(*by, "_r").agg(F.max(F.when(F.col(repeat) == 0, F.col(value))).alias("_x"), F.max(F.when(F.col(repeat) == 1, F.col(value))).alias("_y")).dropna()
    share = paired.groupBy(*by).agg(F.avg((F.col("_x") < F.col("_y")).cast("double")).alias("_s"))
    out = n.join(share, by, "left")
    by_count = F.least("_a", "_b") < least_ratio * F.greatest("_a", "_b")
    return out.select(*by, F.when(by_count, (F.col("_b") > F.col("_a")).cast("int")).otherwise((F.coalesce("_s", F.lit(0.0)) > 0.5).cast("int")).alias("best"))
