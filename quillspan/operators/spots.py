"""Spots, probes and codes: corrections, screening, comparison and assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance


def without_carry_over(spots: DataFrame, pairs: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Spots of a later round removed where a spot of the earlier round lies near (a pair) and is brighter by the ratio.
    ``pairs`` has the keys of the later spot, its brightness and the earlier one's as ``other``."""
    bad = pairs.filter(F.col("other") > ratio * F.col("brightness")).select(*keys).distinct()
    return spots.join(bad, keys, "left_anti")


def corrected(spots: DataFrame, drift: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Coordinates less the drift of their round; rounds without a drift stay."""
    d = drift.select(*by, *[F.col(c).alias(f"_{c}") for c in axes])
    return spots.join(d, by, "left").select(*[(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))).alias(c) if c in axes else F.col(c) for c in spots.columns])


def polynomial(parts: list[Column], coefficients: list[float], order: int) -> Column:
    """A full polynomial of the given order: all products of powers with that total at most, in order of total."""
    terms, total = [], F.lit(0.0)
    powers = [p for n in range(order + 1) for p in _powers(len(parts), n)]
    for power, c in zip(powers, coefficients, strict=True):
        term = F.lit(float(c))
        for x, n in zip(parts, power, strict=True):
            for _ in range(n):
                term = term * x
        terms.append(term)
    for t in terms:
        total = total + t
    return total


def _powers(axes: int, total: int) -> list[tuple[int, ...]]:
    if axes == 1:
        return [(total,)]
    return [(n, *rest) for n in range(total, -1, -1) for rest in _powers(axes - 1, total - n)]


def replaced(spots: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Values of matching keys replaced; keys of ``new`` are unique (else it raises when run)."""
    once = new.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(v).alias(f"_{v}") for v in values])
    once = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key is not unique")).cast("boolean")).otherwise(F.lit(True)))
    out = spots.join(once, key, "left")
    return out.select(*[F.when(F.coalesce("_ok", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in spots.columns])


def share_changed(a: DataFrame, b: DataFrame, key: list[str], axes: list[str], least: float = 0.01) -> DataFrame:
    """Share of keys measured in both whose places are at least ``least`` apart."""
    other = b.select(*key, *[F.col(c).alias(f"_{c}") for c in axes])
    d = distance([F.col(c) for c in axes], [F.col(f"_{c}") for c in axes])
    return a.join(other, key).agg(F.avg(F.when(d.isNotNull(), (d >= least).cast("double"))).alias("changed"), F.count(d).alias("n"))


def near_reference(spots: DataFrame, reference: DataFrame, by: list[str], axes: list[str], most: float, keep_without: bool = False) -> DataFrame:
    """Spots at most ``most`` from a reference spot of the same region; those of regions without one by the switch."""
    r = reference.dropna(subset=axes).select(*by, *[F.col(c).alias(f"_{c}") for c in axes])
    d = distance([F.col(c) for c in axes], [F.col(f"_{c}") for c in axes])
    one = r.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_{c}" for c in axes])
    same = [F.col(c) == F.col(f"_by_{c}") for c in by]
    found = spots.join(one, [*same, d <= most], "left_semi")  # no row for each pair
    if keep_without:
        found = found.unionByName(spots.join(r.select(*by).distinct(), by, "left_anti").select(*spots.columns))
    return found.distinct()


def snapped(starts: DataFrame, reference: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Starts with exactly one reference start within the reach, moved to it.  Both meet in cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / (reach or 1)).cast("long")
    left = starts.withColumn("_c", cell("start"))
    right = reference.withColumn("_c", F.explode(F.sequence(cell("ref") - 1, cell("ref") + 1)))
    both = left.join(right, [*by, "_c"]).drop("_c").filter(F.abs(F.col("start") - F.col("ref")) <= reach)
    return both.withColumn("_n", F.count("*").over(W.partitionBy(*by, "start"))).filter("_n = 1").drop("_n")


def load_balance(codes: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Population spread of the number of codes by round in each group; rounds without any count as zero."""
    n = codes.groupBy(*by).pivot("round", list(range(rounds))).count().fillna(0)
    values = [F.col(str(r)).cast("double") for r in range(rounds)]
    mean = sum(values, F.lit(0.0)) / rounds
    return n.select(*by, F.sqrt(sum(((v - mean) * (v - mean) for v in values), F.lit(0.0)) / rounds).alias("spread"))


def pieces(rows: DataFrame, id_: str, sequence: Column, size: int) -> DataFrame:
    """A sequence cut into pieces of ``size`` (the last may be shorter), with their place."""
    n = F.ceil(F.length(sequence) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    return rows.select(id_, sequence.alias("_s"), at.alias("piece")).select(id_, "piece", F.substring("_s", F.col("piece") * size + 1, F.lit(size)).alias("sequence"))


def homolog_centres(points: DataFrame, by: str, locus: str) -> DataFrame:
    """By group: the two points that, as centres, split the group's points (each to the nearer one, ties to the first) so that most
    loci have points on both sides, and of these the pair with the least sum of both sides' mean distances; ``z1 .. y2`` are the
    medians of both sides.  A grouped-map function: a group is the candidates of one chromosome in one cell."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values([locus, "candidate"])
        names = [by, "covered", "spread", "z1", "x1", "y1", "z2", "x2", "y2"]
        if len(pdf) < 2:
            return pd.DataFrame([], columns=names)
        xyz = pdf[["z", "x", "y"]].to_numpy(float)
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        _, where = np.unique(pdf[locus].to_numpy(), return_inverse=True)
        of = np.zeros((where.max() + 1, len(pdf)), bool)
        of[where, np.arange(len(pdf))] = True
        top, pair = (0, -np.inf), (1, 0)
        for one in range(1, len(pdf)):
            second = d[one][None, :] > d[:one]  # nearer to the other centre; rows: the other centre
            both = ((of[:, None] & second[None]).any(-1) & (of[:, None] & ~second[None]).any(-1)).sum(0)
            for other in np.flatnonzero(both >= top[0]).tolist():
                there = second[other]
                spread = d[one][~there].mean() + (d[other][there].mean() if there.any() else np.inf)
                if (int(both[other]), -spread) > top:
                    top, pair = (int(both[other]), -spread), (one, other)
        there = d[pair[0]] > d[pair[1]]
        sides = [np.median(xyz[s], axis=0) if s.any() else np.full(3, np.nan) for s in (~there, there)]
        return pd.DataFrame([(pdf[by].iloc[0], top[0], -top[1], *sides[0], *sides[1])], columns=names)

    kind = dict(points.dtypes)[by]
    return points.select(by, locus, "candidate", "z", "x", "y").groupBy(by).applyInPandas(best, f"{by} {kind}, covered long, spread double, z1 double, x1 double, y1 double, z2 double, x2 double, y2 double")


def translation_vote(fixed: DataFrame, target: DataFrame, by: list[str], axes: list[str], cutoff: float, resolution: float) -> DataFrame:
    """By group: the translation from the fixed points to the target points.  Both have an ``id``.

    1. Pairs of fixed points vote with pairs of target points whose inner distance differs by less than the cutoff (an equi-join on
       distance bins of that width): the first fixed point less either target point.
    2. Votes are counted in a grid of ``resolution`` from the least vote on; the fullest cell (ties: least) gives a first guess.
    3. Each fixed point takes its nearest moved target (ties: least id) if within twice the resolution; the result is the median of
       target less fixed over these.
    The number of votes grows with the fourth power of a group's points, as the method asks; it is meant for groups of a hundred."""
    keys = [F.col(c) for c in by]

    def inner(rows: DataFrame, tag: str) -> DataFrame:
        a = rows.select(*keys, F.col("id").alias("i"), *[F.col(c).alias(f"{c}1{tag}") for c in axes])
        b = rows.select(*keys, F.col("id").alias("j"), *[F.col(c).alias(f"{c}2{tag}") for c in axes])
        d = distance([F.col(f"{c}1{tag}") for c in axes], [F.col(f"{c}2{tag}") for c in axes])
        return a.join(b, by).filter("i < j").drop("i", "j").withColumn(f"d{tag}", d).filter(F.col(f"d{tag}").isNotNull())

    cell = lambda c: F.floor(F.col(c) / cutoff).cast("long")
    f = inner(fixed, "f").withColumn("_bin", cell("df"))
    t = inner(target, "t").withColumn("_bin", F.explode(F.sequence(cell("dt") - 1, cell("dt") + 1)))
    agreed = f.join(t, [*by, "_bin"]).filter(F.abs(F.col("df") - F.col("dt")) < cutoff)
    ends = F.explode(F.array(*[F.struct(*[(F.col(f"{c}1f") - F.col(f"{c}{k}t")).alias(c) for c in axes]) for k in (1, 2)]))
    votes = agreed.select(*by, ends.alias("v")).select(*by, *[F.col(f"v.{c}").alias(c) for c in axes])
    reach = votes.groupBy(*by).agg(*[x for c in axes for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))])
    n = lambda c: F.floor((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / resolution) + 1
    step = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / n(c)
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}_lo"), step(c))), n(c) - 1), F.lit(0)).cast("long")
    counted = votes.join(reach, by).groupBy(*by, *[place(c).alias(f"k{c}") for c in axes], *[(step(c)).alias(f"s{c}") for c in axes], *[F.col(f"{c}_lo") for c in axes]).agg(F.count("*").alias("votes"))
    w = W.partitionBy(*by).orderBy(F.desc("votes"), *[f"k{c}" for c in axes])
    guess = counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "votes", *[(F.col(f"{c}_lo") + F.col(f"k{c}") * F.col(f"s{c}")).alias(f"{c}_g") for c in axes])
    moved = target.join(guess, by).select(*by, "votes", F.col("id").alias("tid"), *[F.col(c).alias(f"{c}_t") for c in axes], *[(F.col(c) + F.col(f"{c}_g")).alias(f"{c}_m") for c in axes])
    off = distance([F.col(c) for c in axes], [F.col(f"{c}_m") for c in axes])
    near = fixed.join(moved, by).withColumn("_d", off).filter(F.col("_d") < 2 * resolution)
    first = W.partitionBy(*by, "id").orderBy("_d", "tid")
    near = near.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return near.groupBy(*by).agg(F.max("votes").alias("votes"), F.count("*").alias("matched"), *[F.median(F.col(f"{c}_t") - F.col(c)).alias(c) for c in axes])


def clusters(points: DataFrame, cutoff: float) -> DataFrame:
    """Complete-linkage clusters of each trace's points, cut where the greatest distance within would exceed the cutoff.  Sequential by
    nature: a grouped-map function over a trace."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("locus")
        xyz = pdf[["z", "x", "y"]].to_numpy()
        n = len(xyz)
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) if n else np.zeros((0, 0))
        np.fill_diagonal(d, np.inf)
        label, live = np.arange(n), np.ones(n, bool)
        while live.sum() > 1:
            flat = int(np.argmin(d))
            i, j = sorted(divmod(flat, n))
            if d[i, j] > cutoff:
                break
            d[i] = d[:, i] = np.maximum(d[i], d[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            label[label == j] = i
            live[j] = False
        return pd.DataFrame({"trace": pdf["trace"], "locus": pdf["locus"], "cluster": pdf["locus"].to_numpy()[label] if n else []})

    return points.select("trace", "locus", "z", "x", "y").groupBy("trace").applyInPandas(link, "trace long, locus long, cluster long")


def decode_by_em(candidates: DataFrame, rounds: int = 5) -> DataFrame:
    """Up to two candidates of each (trace, locus), by the product of pooled cdfs of their features; the cdfs are refreshed from the
    chosen ones each round (a feature's cdf at a value is the share of chosen candidates with at most that value)."""
    from quillspan.operators.aggregates import pooled_cdf
    from quillspan.sources.files import written

    w = W.partitionBy("trace", "locus").orderBy(F.desc("score"), "candidate")
    chosen = candidates
    for _ in range(rounds):
        scored = candidates.withColumn("score", F.lit(1.0))
        for c in ("brightness", "spread"):
            cdf = pooled_cdf(candidates, chosen, c)
            scored = scored.join(cdf, F.col(c).eqNullSafe(F.col("_value"))).withColumn("score", F.col("score") * (F.col("_cdf") if c == "brightness" else 1 - F.col("_cdf") + 0.001)).drop("_value", "_cdf")
        chosen = written(scored.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").drop("_r"))
    return chosen


def refined(candidates: DataFrame, centres: DataFrame, brightness: str, reach: float) -> DataFrame:
    """By trace, locus and side: the candidates go to the side of their nearest centre (trace, side, place; ties: least side); of each
    locus and side the brightest within the reach of the centre stays, else the nearest (ties: least candidate)."""
    c = centres.select("trace", "side", *[F.col(x).alias(f"{x}_c") for x in ("z", "x", "y")])
    d = distance([F.col(x) for x in ("z", "x", "y")], [F.col(f"{x}_c") for x in ("z", "x", "y")])
    off = candidates.join(c, "trace").withColumn("_d", F.round(d, 12))
    own = off.withColumn("_r", F.row_number().over(W.partitionBy("trace", "locus", "candidate").orderBy("_d", "side"))).filter("_r = 1")
    near = F.col("_d") < reach
    order = W.partitionBy("trace", "locus", "side").orderBy(F.when(near, 0).otherwise(1), F.when(near, -F.col(brightness)).otherwise(F.col("_d")), "candidate")
    return own.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_d", "z_c", "x_c", "y_c")


def midpoints(a: DataFrame, b: DataFrame, by: list[str], id_: str, brightness: str, axes: list[str], reach: float) -> DataFrame:
    """Candidates of two readouts: pairs within the reach, at the middle of both, with the sum of their brightness."""
    from quillspan.operators.joins import radius_join

    near = radius_join(a.withColumnRenamed(id_, "a"), b.withColumnRenamed(id_, "b"), axes, reach, by, "a", "b")
    side = lambda rows, s: rows.select(*by, F.col(id_).alias(s), F.col(brightness).alias(f"_v{s}"), *[F.col(c).alias(f"{c}_{s}") for c in axes])
    both = near.join(side(a, "a"), [*by, "a"]).join(side(b, "b"), [*by, "b"])
    return both.select(*by, "a", "b", *[((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(c) for c in axes], (F.col("_va") + F.col("_vb")).alias("brightness"))


def rigid(pairs: DataFrame, by: str) -> DataFrame:
    """By group of matched points (z, x, y) and (z2, x2, y2): the rotation (nine numbers by row) and translation with the least squared
    error from the first to the second, and that error's root mean square.  Nine sums a group leave the data; the rest is a 3 x 3
    problem, solved in a grouped-map function over one row."""
    one, two = ["z", "x", "y"], ["z2", "x2", "y2"]
    good = pairs.dropna(subset=[*one, *two])
    sums = good.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in [*one, *two]], *[F.avg(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a in one for b in two], *[F.avg(F.col(c) * F.col(c)).alias(f"q_{c}") for c in [*one, *two]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m1, m2 = np.array([r[f"m_{c}"] for c in one]), np.array([r[f"m_{c}"] for c in two])
        h = np.array([[r[f"p_{a}_{b}"] for b in two] for a in one]) - np.outer(m1, m2)
        u, s, vt = np.linalg.svd(h)
        flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
        turn = vt.T @ flip @ u.T
        spread = sum(r[f"q_{c}"] for c in [*one, *two]) - m1 @ m1 - m2 @ m2
        error = float(np.sqrt(max(spread - 2 * np.trace(np.diag(s) @ flip), 0)))
        return pd.DataFrame({by: [r[by]], "n": [int(r["n"])], "rotation": [turn.ravel().tolist()], "translation": [(m2 - turn @ m1).tolist()], "error": [error]})

    return sums.groupBy(by).applyInPandas(solve, f"{by} {dict(pairs.dtypes)[by]}, n long, rotation array<double>, translation array<double>, error double")


def channels(rows: DataFrame, number: str, n: int) -> DataFrame:
    """The channel and frame of interleaved images by their number."""
    return rows.withColumn("channel", F.pmod(number, F.lit(n)).cast("long")).withColumn("frame", F.floor(F.col(number) / n))


def first_place(rows: DataFrame, by: str, order: list[str], marked: Column) -> DataFrame:
    """by and the place (from 1) of the group's first marked row in order; 0 without one."""
    n = rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).withColumn("_m", marked)
    return n.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_m"), F.col("_n"))), F.lit(0)).cast("long").alias("place"))


def share_ambiguous(candidates: DataFrame, by: list[str], locus: str) -> DataFrame:
    """By group: the share of its loci with more than one candidate, an estimate of the coverage error."""
    n = candidates.groupBy(*by, locus).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.avg((F.col("_n") > 1).cast("double")).alias("share_ambiguous"))


def median_centres(points: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Median place of each group's measured points."""
    return points.dropna(subset=axes).groupBy(*by).agg(*[F.median(c).alias(c) for c in axes])


def repeat_ratios(rows: DataFrame, key: str, repeat: str, value: str) -> DataFrame:
    """key and the median of repeat 0 over that of repeat 1, where both were measured."""
    m = rows.groupBy(key).agg(*[F.median(F.when(F.col(repeat) == k, F.col(value))).alias(f"m{k}") for k in (0, 1)])
    return m.dropna().select(key, F.try_divide("m0", "m1").alias("ratio"))


def dealt_readouts(rows: DataFrame, readouts: DataFrame, number: str, name: str, channels: int) -> DataFrame:
    """Rows with a channel and a readout (numbered from 0) by their number, in turn."""
    n = readouts.agg(F.count("*").alias("_c"))
    keyed = rows.join(F.broadcast(n)).withColumn("_r", F.pmod(number, "_c"))
    return keyed.join(readouts.select(F.col("n").alias("_r"), F.col(name).alias("readout")), "_r").withColumn("channel", F.pmod(number, F.lit(channels))).drop("_r", "_c")


def decode_with_centres(candidates: DataFrame, centres: DataFrame, rounds: int = 5) -> DataFrame:
    """decode_by_em with a third feature: the distance to the nearer of the group's two centres (trace, side, z, x, y); the chosen
    candidates carry their side, at most one for each locus and side.  Centres are refreshed as the medians of the chosen ones."""
    from quillspan.operators.aggregates import pooled_cdf
    from quillspan.sources.files import written

    axes = ["z", "x", "y"]
    w = W.partitionBy("trace", "locus", "side").orderBy(F.desc("score"), "candidate")
    chosen = None
    for _ in range(rounds):
        c = centres.select("trace", "side", *[F.col(x).alias(f"{x}_c") for x in axes])
        near = candidates.join(c, "trace").withColumn("centre_dist", distance([F.col(x) for x in axes], [F.col(f"{x}_c") for x in axes])).drop(*[f"{x}_c" for x in axes])
        near = near.withColumn("_r", F.row_number().over(W.partitionBy("trace", "locus", "candidate").orderBy(F.round("centre_dist", 12), "side"))).filter("_r = 1").drop("_r")
        near = written(near)
        pool = near if chosen is None else chosen
        scored = near.withColumn("score", F.lit(1.0))
        for name in ("brightness", "spread", "centre_dist"):
            cdf = pooled_cdf(near, pool, name)
            scored = scored.join(cdf, F.col(name).eqNullSafe(F.col("_value"))).withColumn("score", F.col("score") * (F.col("_cdf") if name == "brightness" else 1 - F.col("_cdf") + 0.001)).drop("_value", "_cdf")
        chosen = written(scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"))
        centres = chosen.groupBy("trace", "side").agg(*[F.median(x).alias(x) for x in axes])
    return chosen


def nearest_pairs(a: DataFrame, b: DataFrame, by: list[str], axes: list[str], most: float) -> DataFrame:
    """By group: the pair (id of a, id of b) with the least Chebyshev distance, if below ``most``, and a less b (ties: least ids)."""
    from quillspan.functions.columns import chebyshev

    left = a.dropna(subset=axes).select(*by, F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in axes])
    right = b.dropna(subset=axes).select(*by, F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in axes])
    both = left.join(right, by).withColumn("dist", chebyshev([F.col(f"{c}_a") for c in axes], [F.col(f"{c}_b") for c in axes])).filter(F.col("dist") < most)
    w = W.partitionBy(*by).orderBy(F.round("dist", 12), "a", "b")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "a", "b", "dist", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"d{c}") for c in axes])
