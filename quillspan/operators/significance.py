"""Ranks, tests and random controls.

Ranks and cdfs within groups come from running counts over distinct values.  The values are cut into ranges at approximate quantiles
of all rows, counts run within (group, range) and start at the sums of the ranges before, so a group that holds most rows, and groups that
are few, are still spread; where the ranges end does not matter for the result.  Tests work on sums over those counts: no rank is
joined back.  p-values are worked out for one row a group.

Controls permute the labels of a trace: the same permutation for any partitioning, as it follows from a hash of trace, locus and
number.  Permutations are folded into moments as they are made; no copy of the table is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

XYZ = ["z", "x", "y"]


def range_ends(rows: DataFrame, columns: list[str], ranges: int = 64) -> dict[str, list[float]]:
    """Where the ranges of each column end: approximate quantiles, in one pass for all columns."""
    if ranges < 2:
        return {c: [] for c in columns}
    found = rows.approxQuantile(columns, [k / ranges for k in range(1, ranges)], 0.005)
    return {c: sorted(set(e)) for c, e in zip(columns, found, strict=True)}


def running(rows: DataFrame, by: list[str], value: str, counts: dict[str, Column], ranges: int = 64, ends: list[float] | None = None) -> DataFrame:
    """by, value and, for each count of the rows with that value in the group: the count, ``run_`` up to and with the value, ``all_``
    of the group.  Nulls are least; counts are longs.  ``ends`` of the ranges are found unless given."""
    ends = range_ends(rows, [value], ranges)[value] if ends is None else ends
    part = F.array_size(F.filter(F.array(*[F.lit(x) for x in ends]).cast("array<double>"), lambda x: x < F.col(value)))
    distinct = rows.groupBy(*by, value).agg(*[c.cast("long").alias(n) for n, c in counts.items()]).withColumn("_part", part)
    sums = distinct.groupBy(*by, "_part").agg(*[F.sum(n).alias(f"_s_{n}") for n in counts])  # at most ``ranges`` rows a group
    w = W.partitionBy(*by)
    sums = sums.select(*by, "_part", *[x for n in counts for x in ((F.sum(f"_s_{n}").over(w.orderBy("_part")) - F.col(f"_s_{n}")).alias(f"_b_{n}"), F.sum(f"_s_{n}").over(w).alias(f"all_{n}"))])
    within = W.partitionBy(*by, "_part").orderBy(value)
    run = distinct.select("*", *[F.sum(n).over(within).alias(f"run_{n}") for n in counts])
    names = [*by, "_part"]
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], *[f"{p}_{n}" for n in counts for p in ("_b", "all")])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
    both = run.join(sums, same)
    return both.select(*by, value, *[x for n in counts for x in (F.col(n), (F.col(f"run_{n}") + F.col(f"_b_{n}")).alias(f"run_{n}"), F.col(f"all_{n}"))])


def group_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and the exact interpolated quantiles of the known values of each group, by name; null for groups without any."""
    known = rows.filter(F.col(value).isNotNull())
    run = running(known, by, value, {"n": F.count("*")})
    at = lambda k: F.min(F.when(F.col("run_n") > k, F.col(value)))
    place = {n: F.lit(s) * (F.col("all_n") - 1) for n, s in shares.items()}
    out = run.groupBy(*by).agg(F.max("all_n").alias("_n"), *[x for n, p in place.items() for x in (at(F.floor(p)).alias(f"_lo_{n}"), at(F.ceil(p)).alias(f"_hi_{n}"))])
    part = lambda s: F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1))
    out = out.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[((1 - part(s)) * F.col(f"_lo_{n}") + part(s) * F.col(f"_hi_{n}")).alias(n) for n, s in shares.items()])
    groups = rows.select(*by).distinct()
    return groups.join(out, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left").drop(*[f"_k{i}" for i in range(len(by))])


def mid_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n and the mean rank (from 1) of the rows with that value among the group's known ones."""
    run = running(rows.filter(F.col(value).isNotNull()), by, value, {"n": F.count("*")})
    return run.select(*by, value, "n", (F.col("run_n") - (F.col("n") - 1) / 2).alias("rank"))


def _tied(n: Column) -> Column:
    return F.sum(n.cast("double") * n * n - n)


def rank_sum(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Wilcoxon's rank-sum (Mann-Whitney) test of the rows of the first sample against the others: n1, n2, u (pairs in which the first is greater, ties a
    half), z with the variance that ties leave, and two-sided p of the normal; ``p_exact`` where there are no ties and at most 400 pairs."""
    known = rows.filter(F.col(value).isNotNull() & first.isNotNull())
    run = running(known, by, value, {"a": F.count_if(first), "b": F.count_if(~first)})
    n = F.col("a") + F.col("b")
    u = F.sum(F.col("a") * (F.col("run_b") - F.col("b") / 2))
    out = run.groupBy(*by).agg(F.max("all_a").alias("n1"), F.max("all_b").alias("n2"), u.alias("u"), _tied(n).alias("_t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    var = n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("_t"), total * (total - 1)))
    out = out.withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(F.greatest(var, F.lit(0.0)))))
    return out.withColumn("p", normal_tails(F.col("z"))).withColumn("p_exact", F.when((F.col("_t") == 0) & (n1 * n2 <= 400), exact_rank_sum("n1", "n2", "u"))).drop("_t")


def signed_rank(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Wilcoxon's signed-rank test of pairs: n (of the differences that are known and not 0), statistic (the lesser rank sum), z with the variance that ties
    leave, and two-sided p of the normal; ``p_exact`` where there are no ties and n is at most 50."""
    d = rows.withColumn("_d", F.col(x) - F.col(y)).filter(F.col("_d").isNotNull() & ~F.isnan("_d") & (F.col("_d") != 0)).withColumn("_a", F.abs("_d"))
    run = running(d, by, "_a", {"a": F.count_if(F.col("_d") > 0), "b": F.count_if(F.col("_d") < 0)})
    n = F.col("a") + F.col("b")
    rank = F.col("run_a") + F.col("run_b") - (n - 1) / 2
    out = run.groupBy(*by).agg(F.max(F.col("all_a") + F.col("all_b")).alias("n"), F.sum(F.col("a") * rank).alias("_p"), F.sum(F.col("b") * rank).alias("_m"), _tied(n).alias("_t"))
    n = F.col("n").cast("double")
    out = out.withColumn("statistic", F.least("_p", "_m"))
    var = (n * (n + 1) * (2 * n + 1) - F.col("_t") / 2) / 24
    out = out.withColumn("z", F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.sqrt(var)))
    out = out.withColumn("p", normal_tails(F.col("z"))).withColumn("p_exact", F.when((F.col("_t") == 0) & (n <= 50), exact_signed_rank("n", "statistic")))
    return out.drop("_p", "_m", "_t")


def ks_test(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test: n1, n2, ks (the greatest difference of the cdfs), p by the limit's series at (sqrt(m) + 0.12 + 0.11 / sqrt(m)) * ks, m = n1 n2 /
    (n1 + n2); ``p_exact`` by counting paths, for at most 10,000 pairs."""
    known = rows.filter(F.col(value).isNotNull() & first.isNotNull())
    run = running(known, by, value, {"a": F.count_if(first), "b": F.count_if(~first)})
    d = F.abs(F.try_divide("run_a", "all_a") - F.try_divide("run_b", "all_b"))
    out = run.groupBy(*by).agg(F.max("all_a").alias("n1"), F.max("all_b").alias("n2"), F.max(d).alias("ks"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    m = F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    out = out.withColumn("p", kolmogorov_tail((m + 0.12 + F.try_divide(F.lit(0.11), m)) * F.col("ks")))
    return out.withColumn("p_exact", F.when((n1 * n2 > 0) & (n1 * n2 <= 10_000), exact_ks("n1", "n2", "ks")))


def t_test(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Student's t of the first sample against the others with pooled variance, degrees of freedom and two-sided p."""
    x = F.col(value)
    one, two = F.when(first, x), F.when(~first, x)
    out = rows.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("_m1"), F.avg(two).alias("_m2"), F.var_samp(one).alias("_v1"), F.var_samp(two).alias("_v2"))
    free = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2"), free)
    out = out.withColumn("t", F.try_divide(F.col("_m1") - F.col("_m2"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))))).withColumn("free", free.cast("double"))
    return out.withColumn("p", t_tails("t", "free")).drop("_m1", "_m2", "_v1", "_v2")


def kolmogorov_tail(x: Column) -> Column:
    """P(K > x) of the limit of sqrt(m) times the statistic: 2 sum (-1)^(k-1) exp(-2 k^2 x^2), below 1 by the series that converges there."""
    k = F.sequence(F.lit(1), F.lit(20))
    above = 2 * F.aggregate(k, F.lit(0.0), lambda a, i: a + F.when(i % 2 == 1, 1).otherwise(-1) * F.exp(-2.0 * i * i * x * x))
    below = 1 - F.lit(math.sqrt(2 * math.pi)) / x * F.aggregate(k, F.lit(0.0), lambda a, i: a + F.exp(-((2 * i - 1) * (2 * i - 1)) * F.lit(math.pi**2 / 8) / (x * x)))
    return F.when(x <= 0, 1.0).when(x < 1, below).otherwise(F.greatest(above, F.lit(0.0)))


@F.pandas_udf(DoubleType())
def normal_tails(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's evaluation of its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.pandas_udf(DoubleType())
def t_tails(t: pd.Series, free: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if math.isnan(v) or not n > 0 else _beta_tail(n / (n + v * v), n / 2, 0.5) for v, n in zip(t.fillna(math.nan), free.fillna(0.0), strict=True)], dtype=float)


def signed_rank_ways(n: int) -> np.ndarray:
    """In how many of the 2**n ways of signs the positive ranks sum to 0, 1, 2, ..."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k]
    return ways


def rank_sum_ways(n1: int, n2: int) -> np.ndarray:
    """In how many orders of n1 and n2 values u is 0, 1, 2, ..."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(n1, rank), 0, -1):
            shift = rank - k  # values of the other sample below the k-th of this one
            if 0 <= shift <= n2:
                ways[k, shift:] += ways[k - 1, : ways.shape[1] - shift]
    return ways[n1]


@F.pandas_udf(DoubleType())
def exact_signed_rank(n: pd.Series, statistic: pd.Series) -> pd.Series:
    def one(k: float, s: float) -> float | None:
        if not 0 < k <= 50:
            return None
        ways = signed_rank_ways(int(k))
        return float(min(1.0, 2 * ways[: int(s) + 1].sum() / ways.sum()))

    return pd.Series([one(k, s) for k, s in zip(n.fillna(0), statistic.fillna(0), strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def exact_rank_sum(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    def one(a: float, b: float, s: float) -> float | None:
        if not 0 < a * b <= 400:
            return None
        ways = rank_sum_ways(int(a), int(b))
        return float(min(1.0, 2 * ways[: int(min(s, a * b - s)) + 1].sum() / ways.sum()))

    return pd.Series([one(a, b, s) for a, b, s in zip(n1, n2, u.fillna(0), strict=True)], dtype=float)


def ks_within(n1: int, n2: int, d: float) -> float:
    """The share of orders of n1 and n2 values whose cdfs stay less than d apart: paths counted step by step as shares."""
    near = lambda i, j: abs(i * n2 - j * n1) < round(d * n1 * n2)
    row = np.zeros(n2 + 1)
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i == j == 0:
                row[0] = 1.0
            elif not near(i, j):
                row[j] = 0.0
            else:
                row[j] = (row[j] * i / (i + j) if i else 0.0) + (row[j - 1] * j / (i + j) if j else 0.0)
    return float(row[n2])


@F.pandas_udf(DoubleType())
def exact_ks(n1: pd.Series, n2: pd.Series, ks: pd.Series) -> pd.Series:
    small = lambda a, b, d: 0 < a * b <= 10_000 and d == d
    return pd.Series([min(1.0, max(0.0, 1 - ks_within(int(a), int(b), d))) if small(a, b, d) else None for a, b, d in zip(n1, n2, ks.fillna(math.nan), strict=True)], dtype=float)


def shuffle_keys(trace: int, loci: np.ndarray, number: int) -> np.ndarray:
    """A key for each locus; their order is the permutation of that number."""
    with np.errstate(over="ignore"):
        h = loci.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(trace % 2**64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(number + 1) * np.uint64(0xA0761D6478BD642F)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def shuffled(trace: int, loci: np.ndarray, labels: np.ndarray, number: int) -> np.ndarray:
    """The labels in the order of the loci's keys (equal keys by locus): as many of each as before."""
    out = np.empty_like(labels)
    out[np.lexsort((loci, shuffle_keys(trace, loci, number)))] = labels
    return out


def density_controls(points: DataFrame, group: str, sigma: float, times: int = 100, least: float = 0.001, apart: list[str] | None = None) -> DataFrame:
    """trace, locus, group, density and, over ``times`` shuffles of the labels of the trace's detected loci: mean, sd and the share of shuffles with at
    least that density.

    The density of a group at a locus is the sum of exp(-d**2 / 2 sigma**2) over its loci more than ``least`` away; with ``apart``, over its
    loci that differ in one of these columns (another chromosome or copy).  Distances are worked out once for 256 loci at a time, and all shuffles are summed over them:
    memory is a trace's loci times 256 or ``times``."""
    others = apart or []

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("locus")
        names = np.array(sorted(set(pdf[group])), object)
        trace, loci, xyz = int(pdf["trace"].iloc[0]), pdf["locus"].to_numpy(), pdf[XYZ].to_numpy(float)
        label = np.searchsorted(names, pdf[group].to_numpy(object))
        drawn = np.stack([shuffled(trace, loci, label, t) for t in range(times)], 1) if times else np.zeros((len(loci), 0), int)
        home = pdf.groupby(others, sort=True, dropna=False).ngroup().to_numpy() if others else None
        out = []
        for low in range(0, len(loci), 256):
            part = slice(low, low + 256)
            d = np.sqrt(((xyz[part, None] - xyz[None]) ** 2).sum(-1))
            kernel = np.exp(-d * d / (2 * sigma * sigma)) * (home[part, None] != home[None] if others else d > least)
            for g, name in enumerate(names):
                now = kernel @ (label == g)
                null = kernel @ (drawn == g).astype(float)
                size = max(times, 1)
                out.append(pd.DataFrame({"trace": trace, "locus": loci[part], "group": np.full(len(now), str(name), object), "density": now, "mean": null.sum(1) / size, "sd": null.std(1) if times else 0.0, "above": (null >= now[:, None] - 1e-12).sum(1) / size}))
        return pd.concat(out)

    kinds = "trace long, locus long, group string, density double, mean double, sd double, above double"
    return points.dropna(subset=[*XYZ, group]).select("trace", "locus", *XYZ, group, *others).groupBy("trace").applyInPandas(work, kinds)


def mixing_controls(points: DataFrame, group: str, sigma: float, times: int = 100) -> DataFrame:
    """trace, score, mean, sd, z and p of how much the groups of a trace keep to themselves: the mean, over its detected loci, of the share of
    their own group in the density at them (themselves left out); mean and sd over ``times`` shuffles of the labels, p the share of shuffles (the true
    labels counted as one) with at least that score."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[*XYZ, group]).sort_values("locus")
        if len(pdf) < 2:
            return pd.DataFrame({c: [] for c in ("trace", "score", "mean", "sd", "z", "p")})
        trace, loci, xyz = int(pdf["trace"].iloc[0]), pdf["locus"].to_numpy(), pdf[XYZ].to_numpy(float)
        label = pd.factorize(pdf[group])[0]
        drawn = np.stack([label, *(shuffled(trace, loci, label, t) for t in range(times))], 1)
        total = np.zeros(drawn.shape[1])
        for low in range(0, len(loci), 256):
            part = np.arange(low, min(low + 256, len(loci)))
            kernel = np.exp(-((xyz[part, None] - xyz[None]) ** 2).sum(-1) / (2 * sigma * sigma))
            kernel[np.arange(len(part)), part] = 0
            whole = kernel.sum(1)
            for g in range(label.max() + 1):
                own = kernel @ (drawn == g).astype(float)
                total += (np.divide(own, whole[:, None], out=np.zeros_like(own), where=whole[:, None] > 0) * (drawn[part] == g)).sum(0)
        score, null = total[0] / len(loci), total[1:] / len(loci)
        mean, sd = (float(null.mean()), float(null.std())) if times else (math.nan, math.nan)
        z = (score - mean) / sd if sd > 0 else None
        return pd.DataFrame({"trace": [trace], "score": [score], "mean": [mean], "sd": [sd], "z": [z], "p": [((null >= score - 1e-12).sum() + 1) / (times + 1)]}, dtype=object)

    return points.select("trace", "locus", *XYZ, group).groupBy("trace").applyInPandas(work, "trace long, score double, mean double, sd double, z double, p double")
