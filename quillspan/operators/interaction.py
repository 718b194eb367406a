"""Interactions between domains of a trace: neighbours, markers, likelihoods and loop-outs.

Segments are a table (trace, segment, first, last) with both ends included and segments numbered in order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance, effect_of, median_of
from quillspan.operators.peaks import peak_places
from quillspan.operators.segments import XYZ, filled, merged_domains, segments_of

_TWO_PI = math.log(2 * math.pi) / 2


def neighbour_distances(points: DataFrame, segments: DataFrame, least: int = 5) -> DataFrame:
    """Median effect between each segment and the next, both cut to the loci at most 2 * max(length of the other, least) from their
    boundary: trace, segment (the first of both), dist."""
    w = W.partitionBy("trace").orderBy("segment")
    n, m = F.col("last") - F.col("first") + 1, F.col("l2") - F.col("f2") + 1
    both = segments.withColumn("f2", F.lead("first").over(w)).withColumn("l2", F.lead("last").over(w)).filter("f2 is not null")
    both = both.select("trace", "segment", F.greatest("first", F.col("last") + 1 - 2 * F.greatest(m, F.lit(least))).alias("a0"), F.col("last").alias("a1"), F.col("f2").alias("b0"), F.least(F.col("l2"), F.col("f2") - 1 + 2 * F.greatest(n, F.lit(least))).alias("b1"))
    p = points.dropna(subset=XYZ)
    near = both.withColumn("locus", F.explode(F.concat(F.sequence("a0", "a1"), F.sequence("b0", "b1")))).join(p.select("trace", "locus", *XYZ), ["trace", "locus"])
    side = lambda s: near.select("trace", "segment", F.col("locus").alias(s), (F.col("locus") >= F.col("b0")).alias(f"_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in XYZ])
    d = distance([F.col(f"{c}_i") for c in XYZ], [F.col(f"{c}_j") for c in XYZ])
    lists = side("i").join(side("j"), ["trace", "segment"]).filter("i < j").groupBy("trace", "segment").agg(F.collect_list(F.when(F.col("_i") != F.col("_j"), d)).alias("b"), F.collect_list(F.when(F.col("_i") == F.col("_j"), d)).alias("w"))
    score = F.when((F.size("b") < 1) | (F.size("w") < 1), F.lit(0.0)).otherwise(effect_of(F.col("b"), F.col("w"), median_of))
    return lists.select("trace", "segment", score.alias("dist"))


def markers(distances: DataFrame, segments: DataFrame, most: float = 0.4, neighbours: bool = False, edges: bool = False, common: bool = False) -> DataFrame:
    """Pairs of segments a < b whose distance, not below 0, is under ``most``; by switch also neighbours and pairs with the first or last
    segment, of their trace or (``common``) of all traces."""
    of = [F.min("segment").alias("_lo"), F.max("segment").alias("_hi")]
    near = distances.filter(F.greatest("domain_dist", F.lit(0.0)) < most)
    out = near.join(F.broadcast(segments.agg(*of))) if common else near.join(segments.groupBy("trace").agg(*of), "trace")
    if not neighbours:
        out = out.filter("b - a > 1")
    if not edges:
        out = out.filter("a <> _lo and b <> _hi")
    return out.select("trace", "a", "b", "domain_dist")


def in_contact(seg_pairs: DataFrame, cutoff: float, share: float) -> DataFrame:
    """trace, a, b and contact of the segment pairs of which more than ``share`` of the measured distances are at most the cutoff."""
    c = seg_pairs.filter("seg_i < seg_j").groupBy("trace", F.col("seg_i").alias("a"), F.col("seg_j").alias("b")).agg(F.avg((F.col("dist") <= cutoff).cast("double")).alias("contact"))
    return c.filter(F.col("contact") > share)


def likelihoods(seg_pairs: DataFrame, called: DataFrame, least: int = 5, w_called: float = 1.0, w_within: float = 1.0) -> DataFrame:
    """trace, a < b and the log-likelihood ratio that the two segments interact.

    For each segment with called partners and others, three normal distributions are fitted: to its distances to partners, to the
    others, and within it (a full matrix with its zero diagonal, of more than ``least`` entries).  The mean over a pair's distances of
    w_called * ln(partner / other) + w_within * ln(within / other), from both ends, is the value; pairs of neighbours, and those of which an end cannot be
    judged, are left out.  All sums come from counts, sums and squares, so no distance is read twice."""
    sums = seg_pairs.groupBy("trace", "seg_i", "seg_j").agg(F.count("dist").alias("n"), F.sum("dist").alias("s"), F.sum(F.col("dist") * F.col("dist")).alias("q"))
    across = sums.filter("seg_i < seg_j")
    both = across.select("trace", F.col("seg_i").alias("own"), F.col("seg_j").alias("other"), "n", "s", "q").unionByName(across.select("trace", F.col("seg_j").alias("own"), F.col("seg_i").alias("other"), "n", "s", "q"))
    pairs = called.select("trace", "a", "b")
    partner = pairs.select("trace", F.col("a").alias("own"), F.col("b").alias("other")).unionByName(pairs.select("trace", F.col("b").alias("own"), F.col("a").alias("other"))).distinct().withColumn("_p", F.lit(True))
    both = both.join(partner, ["trace", "own", "other"], "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    part = lambda c, name: [F.sum(F.when(c, F.col(x))).alias(f"{x}_{name}") for x in "nsq"]
    fits = both.groupBy("trace", "own").agg(*part(F.col("_p"), "p"), *part(~F.col("_p"), "o"))
    members = (1 + F.sqrt(1 + 8 * F.col("n"))) / 2  # of n pairs, all measured
    within = sums.filter("seg_i = seg_j").select("trace", F.col("seg_i").alias("own"), (2 * F.col("n") + F.round(members)).alias("n_w"), (2 * F.col("s")).alias("s_w"), (2 * F.col("q")).alias("q_w"))
    fits = fits.join(within, ["trace", "own"]).filter((F.col("n_w") > least) & (F.col("n_p") > 0) & (F.col("n_o") > 0))
    for k in "pow":
        mean = F.col(f"s_{k}") / F.col(f"n_{k}")
        fits = fits.withColumn(f"m_{k}", mean).withColumn(f"v_{k}", F.col(f"q_{k}") / F.col(f"n_{k}") - mean * mean)

    def mean_log(k: str) -> Column:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        square = F.col("q") / F.col("n") - 2 * m * F.col("s") / F.col("n") + m * m
        return -square / (2 * v) - F.ln(v) / 2 - _TWO_PI

    one = both.filter("abs(own - other) > 1 and n > 0").select("trace", "own", "other", "n", "s", "q").join(fits.filter("v_p > 0 and v_o > 0 and v_w > 0").drop(*[f"{x}_{k}" for x in "nsq" for k in "pow"]), ["trace", "own"])
    one = one.select("trace", "own", "other", (w_called * mean_log("p") + w_within * mean_log("w") - (w_called + w_within) * mean_log("o")).alias("ratio"))
    back = one.select("trace", F.col("other").alias("own"), F.col("own").alias("other"), F.col("ratio").alias("_back"))
    return one.filter("own < other").join(back, ["trace", "own", "other"]).select("trace", F.col("own").alias("a"), F.col("other").alias("b"), (F.col("ratio") + F.col("_back")).alias("likelihood"))


def loop_out_hits(points: DataFrame, segments: DataFrame, below: float = 0.0) -> DataFrame:
    """trace, locus, segment and score of the segments that a locus inside another segment (not at its ends) is nearer to than to its own:
    median effect of its distances to their loci against those to its own segment's (itself included, at 0)."""
    p = segments_of(points.dropna(subset=XYZ), segments).select("trace", "locus", "segment", *XYZ)
    ends = segments.select("trace", F.col("segment").alias("own"), "first", "last")
    here = p.withColumnRenamed("segment", "own").join(ends, ["trace", "own"]).filter("locus > first and locus < last").drop("first", "last")
    there = p.select("trace", "segment", *[F.col(c).alias(f"{c}_r") for c in XYZ])
    d = distance([F.col(c) for c in XYZ], [F.col(f"{c}_r") for c in XYZ])
    lists = here.join(there, "trace").groupBy("trace", "locus", "own", "segment").agg(F.collect_list(d).alias("d"))
    own = lists.filter("own = segment").select("trace", "locus", F.col("d").alias("_s"))
    both = lists.join(own, ["trace", "locus"]).withColumn("score", effect_of(F.col("d"), F.col("_s"), median_of))
    return both.filter(F.col("score") < below).select("trace", "locus", "segment", "score")


def correlation_distances(points: DataFrame, segments: DataFrame) -> DataFrame:
    """trace, a < b and the distance of the segments' mean rows in the correlation map of the interpolated trace, over its loci.  The map is
    of a whole trace: a grouped-map function over it."""

    def work(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        pdf, cuts = pdf.sort_values("locus"), cuts.sort_values("segment")
        xyz = pdf[XYZ].to_numpy(float)
        if (~np.isnan(xyz).any(1)).sum() < 2 or not len(cuts):
            return pd.DataFrame({"trace": [], "a": [], "b": [], "dist": []})
        whole = np.column_stack([filled(xyz[:, k]) for k in range(3)])
        corr = np.corrcoef(np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1)))
        loci = pdf["locus"].to_numpy()
        rows = np.array([corr[(loci >= a) & (loci <= b)].mean(0) for a, b in zip(cuts["first"], cuts["last"], strict=True)])
        i, j = np.triu_indices(len(rows), 1)
        names = cuts["segment"].to_numpy()
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "a": names[i], "b": names[j], "dist": np.sqrt(((rows[i] - rows[j]) ** 2).sum(1)) / len(loci)})

    return points.select("trace", "locus", *XYZ).groupBy("trace").cogroup(segments.groupBy("trace")).applyInPandas(work, "trace long, a long, b long, dist double")


def sliding_domains(scores: DataFrame, points: DataFrame, size: int, prominence: float, merge: bool = True, width: float = 0.0, **bounds: float) -> DataFrame:
    """Segments of each trace that begin at 0 and at the peaks of its boundary scores (trace, c, score), at least ``size`` apart and with
    the prominence; by switch merged like ``merged_domains`` from these starts."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        at, *_ = peak_places(pdf["score"].fillna(0).to_numpy(float), size, prominence, width)
        starts = np.append(0, at)
        place = pdf["c"].to_numpy()
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "segment": range(len(starts)), "first": place[starts], "last": place[np.append(starts[1:], len(place)) - 1]})

    found = scores.select("trace", "c", "score").groupBy("trace").applyInPandas(cut, "trace long, segment long, first long, last long")
    return merged_domains(points, size, starts=found, **bounds) if merge else found


def fused(points: DataFrame, segments: DataFrame, percent: float = 90.0) -> DataFrame:
    """Pairs of segments a < b of a trace whose centres (medians of each axis) are nearer than the sum of their radii, a radius being the
    percentile of the distances of a segment's loci from its centre."""
    p = segments_of(points.dropna(subset=XYZ), segments).select("trace", "segment", *XYZ)
    centre = p.groupBy("trace", "segment").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{c}") for c in XYZ])
    off = p.join(centre, ["trace", "segment"]).withColumn("_d", distance([F.col(c) for c in XYZ], [F.col(f"m{c}") for c in XYZ]))
    s = off.groupBy("trace", "segment").agg(F.percentile("_d", F.lit(percent / 100)).alias("r"), *[F.first(f"m{c}").alias(c) for c in XYZ])
    a, b = (s.select("trace", F.col("segment").alias(e), F.col("r").alias(f"r_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in XYZ]) for e in "ab")
    d = distance([F.col(f"{c}_a") for c in XYZ], [F.col(f"{c}_b") for c in XYZ])
    return a.join(b, "trace").filter("a < b").withColumn("dist", d).filter(F.col("dist") < F.col("r_a") + F.col("r_b")).select("trace", "a", "b", "dist")


def exchanged(called: DataFrame, judged: DataFrame, percent: float = 5.0, rate: float = 0.1) -> DataFrame:
    """The called pairs (trace, a, b) after one round of exchange by likelihoods (trace, a, b, likelihood).

    By trace: ``low`` is the ``percent`` percentile of the called pairs' likelihoods, ``high`` that of 100 - ``percent`` of the others'.
    If low is below high, both are moved towards each other by ``rate`` of their difference; called pairs below low, or without a
    likelihood, go, and others above high are called.  Else, and where either side is empty, nothing changes."""
    pairs = called.select("trace", "a", "b").distinct()
    both = judged.select("trace", "a", "b", "likelihood").join(pairs.withColumn("_c", F.lit(True)), ["trace", "a", "b"], "full").withColumn("_c", F.coalesce("_c", F.lit(False)))
    q = both.groupBy("trace").agg(F.percentile(F.when(F.col("_c"), F.col("likelihood")), F.lit(percent / 100)).alias("_s"), F.percentile(F.when(~F.col("_c"), F.col("likelihood")), F.lit(1 - percent / 100)).alias("_o"))
    rows = both.join(q, "trace")
    move = rate * (F.col("_o") - F.col("_s"))
    moves = F.coalesce(F.col("_s") < F.col("_o"), F.lit(False))
    stays = F.when(F.col("_c"), F.coalesce(F.col("likelihood") >= F.col("_s") + move, F.lit(False))).otherwise(F.coalesce(F.col("likelihood") > F.col("_o") - move, F.lit(False)))
    return rows.filter(F.when(moves, stays).otherwise(F.col("_c"))).select("trace", "a", "b")


def called_by_likelihood(seg_pairs: DataFrame, called: DataFrame, rounds: int = 10, w_called: float = 1.0, w_within: float = 0.05, cutoff: float | None = None, share: float = 0.1, **options: float) -> DataFrame:
    """trace, a, b and ``settled`` after exchange in rounds, until no pair changes or ``rounds`` are done; ``settled`` is false for the traces that changed in
    the last round.  With a cutoff, each round ends by leaving out pairs of which at most ``share`` of the distances are contacts.  Each
    round is DataFrame work, written to cut its lineage."""
    from quillspan.sources.files import written

    seg_pairs, called = written(seg_pairs), written(called.select("trace", "a", "b").distinct())
    touching = None if cutoff is None else written(in_contact(seg_pairs, cutoff, share).select("trace", "a", "b"))
    moving = called.select("trace").distinct()
    for _ in range(rounds):
        new = exchanged(called, likelihoods(seg_pairs, called, w_called=w_called, w_within=w_within), **options)
        new = written(new if touching is None else new.join(touching, ["trace", "a", "b"], "left_semi"))
        moving = written(new.exceptAll(called).unionByName(called.exceptAll(new)).select("trace").distinct())
        called = new
        if not moving.limit(1).count():
            break
    return called.join(moving.withColumn("_m", F.lit(False)), "trace", "left").select("trace", "a", "b", F.coalesce("_m", F.lit(True)).alias("settled"))


def labels_of(xyz: np.ndarray, reach: float, least: int) -> np.ndarray:
    """Density clusters: points with ``least`` points within the reach (themselves included) are cores, cores within the reach of each other
    are one cluster, other points within the reach of a core join the first such; the rest are -1.  Clusters are numbered by their
    first core."""
    near = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) <= reach
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(xyz)), len(xyz))
    link = near & core[:, None] & core[None]
    while True:
        new = np.where(core, np.where(link, label[None], len(xyz)).min(1, initial=len(xyz)), len(xyz))
        if np.array_equal(new, label):
            break
        label = new
    for i in np.flatnonzero(~core & (near & core[None]).any(1)):
        label[i] = label[np.flatnonzero(near[i] & core)[0]]
    names = np.unique(label[core])
    return np.where(label < len(xyz), np.searchsorted(names, label), -1)


def fused_by_clusters(points: DataFrame, segments: DataFrame, reach: float, least: int = 2, share: float = 0.5) -> DataFrame:
    """Pairs of segments a < b of a trace whose points, clustered together, mostly (more than ``share`` of each one's clustered points) lie
    in the same cluster.  Clustering needs the points of a pair together: a grouped-map function over a trace."""

    def most(label: np.ndarray) -> tuple[int, float]:
        names, n = np.unique(label[label >= 0], return_counts=True)
        return (int(names[n.argmax()]), n.max() / n.sum()) if len(n) else (-1, 0.0)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(k, g[XYZ].to_numpy(float)) for k, g in pdf.sort_values("locus").groupby("segment")]
        out = []
        for j, (b, second) in enumerate(parts):
            for a, first in parts[:j]:
                label = labels_of(np.concatenate([first, second]), reach, least)
                one, two = most(label[: len(first)]), most(label[len(first) :])
                if one[0] == two[0] >= 0 and min(one[1], two[1]) > share:
                    out.append((pdf["trace"].iloc[0], a, b))
        return pd.DataFrame(out, columns=["trace", "a", "b"])

    p = segments_of(points.dropna(subset=XYZ), segments).select("trace", "locus", "segment", *XYZ)
    return p.groupBy("trace").applyInPandas(work, "trace long, a long, b long")


def merged_by_contact(points: DataFrame, segments: DataFrame, cutoff: float, share: float) -> DataFrame:
    """Segments after neighbours are merged, those with the greatest share of contacts (of all pairs of their loci; undetected ones are
    none) first, while one is above ``share``.  Each merge changes the next: a grouped-map function over a trace."""

    def work(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("locus")
        xyz, loci = pdf[XYZ].to_numpy(float), pdf["locus"].to_numpy()
        if not len(cuts) or not len(pdf):
            return pd.DataFrame({"trace": [], "segment": [], "first": [], "last": []})
        touch = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) <= cutoff
        starts = sorted(np.searchsorted(loci, cuts["first"]).tolist())
        while len(starts) > 1:
            edges = [*starts, len(loci)]
            contact = [touch[edges[k - 1] : edges[k], edges[k] : edges[k + 1]].mean() for k in range(1, len(starts))]
            if max(contact) <= share:
                break
            del starts[int(np.argmax(contact)) + 1]
        edges = [*starts, len(loci)]
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "segment": range(len(starts)), "first": loci[starts], "last": loci[np.array(edges[1:]) - 1]})

    return points.select("trace", "locus", *XYZ).groupBy("trace").cogroup(segments.groupBy("trace")).applyInPandas(work, "trace long, segment long, first long, last long")


def candidate_boundaries(scores: DataFrame, points: DataFrame, size: int, reach: int = 1) -> DataFrame:
    """trace and place of the candidate boundaries: 0, and the peaks of the distance between the correlation rows on both sides (``size``
    each) that lie within the reach of a peak of the boundary scores (trace, c, score).  The correlation map is of a whole trace: a
    grouped-map function over it."""

    def work(pdf: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        pdf, scored = pdf.sort_values("locus"), scored.sort_values("c")
        xyz = pdf[XYZ].to_numpy(float)
        if not len(scored) or (~np.isnan(xyz).any(1)).sum() < 2:
            return pd.DataFrame({"trace": [], "c": []})
        slide, *_ = peak_places(scored["score"].fillna(0).to_numpy(float), size)
        whole = np.column_stack([filled(xyz[:, k]) for k in range(3)])
        corr = np.corrcoef(np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1)))
        change = np.array([np.sqrt(((corr[i - size : i] - corr[i : i + size]) ** 2).sum()) for i in range(size, len(corr) - size)])
        at = peak_places(change, size)[0] + size if len(change) else np.zeros(0, int)
        keep = [0, *(int(p) for p in at if len(slide) and np.abs(slide - p).min() <= reach)]
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "c": pdf["locus"].to_numpy()[keep]})

    return points.select("trace", "locus", *XYZ).groupBy("trace").cogroup(scores.select("trace", "c", "score").groupBy("trace")).applyInPandas(work, "trace long, c long")
