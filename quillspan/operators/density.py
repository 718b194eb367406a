"""Densities, sizes and mixing of groups of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance, gaussian

XYZ = ["z", "x", "y"]


def density_scores(points: DataFrame, group: str, sigma: float, least: float = 0.001) -> DataFrame:
    """By point and group: the sum of exp(-d**2 / 2 sigma**2) over the trace's points of the group more than ``least`` away."""
    good = points.dropna(subset=XYZ)
    a = good.select("trace", "locus", *XYZ)
    b = good.select("trace", F.col(group).alias("group"), *[F.col(c).alias(f"{c}_r") for c in XYZ])
    both = a.join(b, "trace").filter(distance([F.col(c) for c in XYZ], [F.col(f"{c}_r") for c in XYZ]) > least)
    part = gaussian([(F.col(f"{c}_r"), F.col(c), F.lit(sigma)) for c in XYZ])
    return both.groupBy("trace", "locus", "group").agg(F.sum(part).alias("density"))


def trans_density(points: DataFrame, chromosome: str, homolog: str, group: str, delta: float, to: float | None = None) -> DataFrame:
    """The same over all loci but those of the same copy of the same chromosome, with width ``delta``.  With ``to``, distances are
    rescaled so that the trace's radius of gyration is that long."""
    good = points.dropna(subset=XYZ)
    a = good.select("trace", "locus", F.col(chromosome).alias("_ca"), F.col(homolog).alias("_ha"), *XYZ)
    b = good.select("trace", F.col(chromosome).alias("_cb"), F.col(homolog).alias("_hb"), F.col(group).alias("group"), *[F.col(c).alias(f"{c}_r") for c in XYZ])
    both = a.join(b, "trace").filter("_ca <> _cb or _ha <> _hb")
    if to is None:
        width = F.lit(delta)
    else:
        both = both.join(gyration(points, ["trace"]).select("trace", "rg"), "trace")
        width = F.lit(delta / to) * F.col("rg")
    part = gaussian([(F.col(f"{c}_r"), F.col(c), width) for c in XYZ])
    return both.groupBy("trace", "locus", "group").agg(F.sum(part).alias("density"))


def gyration(points: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square distance from the group's centre: one pass over moments of each axis."""
    var = sum((F.var_pop(c) for c in XYZ), F.lit(0.0))
    return points.dropna(subset=XYZ).groupBy(*by).agg(F.sqrt(var).alias("rg"), F.count("*").alias("n"))


def segregation(scores: DataFrame, by: list[str], own: str, share: float = 0.33) -> DataFrame:
    """By trace and group: the group's cloud is all points whose density of the group is at least the ``share`` quantile of that
    density over the group's *own* points; ``purity`` is the share of the cloud that belongs to the group, ``score`` the mean
    of the trace's purities."""
    q = scores.filter(F.col(own) == F.col("group")).groupBy(*by, "group").agg(F.percentile("density", F.lit(share)).alias("_q"))
    cloud = scores.join(q, [*by, "group"]).filter(F.col("density") >= F.col("_q"))
    out = cloud.groupBy(*by, "group").agg(F.avg((F.col(own) == F.col("group")).cast("double")).alias("purity"))
    return out.withColumn("score", F.avg("purity").over(W.partitionBy(*by)))


def rank_in_trace(points: DataFrame, value: str) -> DataFrame:
    return points.withColumn("rank", F.row_number().over(W.partitionBy("trace").orderBy(F.desc(value), "locus")))


def density_overlap(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """sum sqrt(d1 d2) / sqrt(sum d1 * sum d2) over cells of two densities."""
    both = a.select(*cell, F.col("density").alias("d1")).join(b.select(*cell, F.col("density").alias("d2")), cell, "full")
    return both.agg(F.try_divide(F.sum(F.sqrt(F.col("d1") * F.col("d2"))), F.sqrt(F.sum("d1") * F.sum("d2"))).alias("overlap"))


def gaussian_divergence(points: DataFrame, group: str) -> DataFrame:
    """Kullback-Leibler divergence of group a's fitted normal distribution (independent axes) from group b's."""
    good = points.dropna(subset=XYZ)
    fit = good.groupBy(F.col(group).alias("g")).agg(*[x for c in XYZ for x in (F.avg(c).alias(f"m{c}"), F.var_pop(c).alias(f"v{c}"))])
    a, b = (fit.select(F.col("g").alias(s), *[F.col(f"{k}{c}").alias(f"{k}{c}_{s}") for c in XYZ for k in "mv"]) for s in "ab")
    v = lambda k, c, s: F.col(f"{k}{c}_{s}")
    parts = [0.5 * (F.ln(v("v", c, "b") / v("v", c, "a")) + (v("v", c, "a") + (v("m", c, "a") - v("m", c, "b")) ** 2) / v("v", c, "b") - 1) for c in XYZ]
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", sum(parts, F.lit(0.0)).alias("kl"))  # one row a group


def axis_projection(points: DataFrame, group: str, one: str, two: str) -> DataFrame:
    """Place of each point along the axis from the centre of group two to that of group one, from their middle on."""
    mean = lambda g, c: F.avg(F.when((F.col(group) == g) & F.col(c).isNotNull(), F.col(c)))
    m = points.groupBy("trace").agg(*[x for c in XYZ for x in (mean(one, c).alias(f"a{c}"), mean(two, c).alias(f"b{c}"))])
    both = points.join(m, "trace")
    dot = sum(((F.col(c) - (F.col(f"a{c}") + F.col(f"b{c}")) / 2) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in XYZ), F.lit(0.0))
    size = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    return both.withColumn("along", F.try_divide(dot, size)).drop(*[f"{s}{c}" for s in "ab" for c in XYZ])


def mask_score(a: DataFrame, b: DataFrame, cell: list[str], percent: float = 50.0) -> DataFrame:
    """sqrt((1 - common / cells of a) * (1 - common / cells of b)) of the cells whose density is above the percentile of the positive ones."""
    q = lambda rows: rows.filter("density > 0").agg(F.percentile("density", F.lit(percent / 100)).alias("_q"))
    mask = lambda rows, name: rows.join(F.broadcast(q(rows))).filter("density > _q").select(*cell, F.lit(1).alias(name))
    both = mask(a, "x").join(mask(b, "y"), cell, "full").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("c"))
    c = F.coalesce("c", F.lit(0))
    return both.select(F.sqrt((1 - F.try_divide(c, F.col("x"))) * (1 - F.try_divide(c, F.col("y")))).alias("score"))


def axis_frame(points: DataFrame, group: str, one: str, two: str) -> DataFrame:
    """Points with ``along`` as in ``axis_projection`` and, across the axis, ``second`` and ``third``: the principal axes of the trace's points in the plane that
    the axis stands on, from their centre, the wider first.  Each points so that its greatest part by size is positive.  Sums of
    coordinates and of their products are enough: one aggregation a trace."""
    p = axis_projection(points, group, one, two)
    good = points.dropna(subset=XYZ)
    mean = lambda g, c: F.avg(F.when(F.col(group) == g, F.col(c)))
    sums = good.groupBy("trace").agg(*[(mean(one, c) - mean(two, c)).alias(f"_u{c}") for c in XYZ], *[F.avg(c).alias(f"_m{c}") for c in XYZ], *[F.covar_pop(a, b).alias(f"_s{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]])
    size = F.sqrt(sum((F.col(f"_u{c}") ** 2 for c in XYZ), F.lit(0.0)))
    sums = sums.select("*", *[F.try_divide(F.col(f"_u{c}"), size).alias(f"_n{c}") for c in XYZ])
    least = F.least(*[F.abs(f"_n{c}") for c in XYZ])
    # two directions across the axis: the axis times the coordinate that it has least of, and the axis times that
    chosen = F.when(F.abs("_nz") == least, 0).when(F.abs("_nx") == least, 1).otherwise(2)
    e = [F.when(chosen == k, 1.0).otherwise(0.0) for k in range(3)]
    n = [F.col(f"_n{c}") for c in XYZ]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    raw = cross(n, e)
    length = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    sums = sums.select("*", *[F.try_divide(raw[k], length).alias(f"_v{k}") for k in range(3)])
    v = [F.col(f"_v{k}") for k in range(3)]
    sums = sums.select("*", *[x.alias(f"_w{k}") for k, x in enumerate(cross(n, v))])
    w = [F.col(f"_w{k}") for k in range(3)]
    cov = lambda i, j: F.col(f"_s{XYZ[min(i, j)]}{XYZ[max(i, j)]}")
    form = lambda a, b: sum((a[i] * cov(i, j) * b[j] for i in range(3) for j in range(3)), F.lit(0.0))
    sums = sums.withColumn("_t", F.atan2(2 * form(v, w), form(v, v) - form(w, w)) / 2)
    turned = {"a": (F.cos("_t"), F.sin("_t")), "b": (-F.sin("_t"), F.cos("_t"))}
    sums = sums.select("*", *[(c * v[k] + s_ * w[k]).alias(f"_{name}{k}") for name, (c, s_) in turned.items() for k in range(3)])
    for name in turned:
        d = [F.col(f"_{name}{k}") for k in range(3)]
        most = F.greatest(*[F.abs(x) for x in d])
        sums = sums.withColumn(f"_g{name}", F.when(F.abs(d[0]) == most, F.signum(d[0])).when(F.abs(d[1]) == most, F.signum(d[1])).otherwise(F.signum(d[2])))
    sums = sums.select("trace", *[f"_m{c}" for c in XYZ], *[(F.col(f"_g{name}") * F.col(f"_{name}{k}")).alias(f"_{name}{k}") for name in turned for k in range(3)])
    both = p.join(sums, "trace", "left")
    place = lambda name: sum(((F.col(c) - F.col(f"_m{c}")) * F.col(f"_{name}{k}") for k, c in enumerate(XYZ)), F.lit(0.0))
    return both.withColumn("second", place("a")).withColumn("third", place("b")).drop(*[f"_m{c}" for c in XYZ], *[f"_{name}{k}" for name in "ab" for k in range(3)])
