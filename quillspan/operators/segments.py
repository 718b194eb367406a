"""Segments (domains) of a trace: distances between them, contacts, and calling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.columns import distance, effect_of, ks_of, mean_of, median_of

XYZ = ["z", "x", "y"]


def segment_pairs(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs with the segment (first, last; both included) of each end: seg_i <= seg_j."""
    s = lambda e: segments.select("trace", F.col("segment").alias(f"seg_{e}"), F.col("first").alias(f"f_{e}"), F.col("last").alias(f"l_{e}"))
    out = pairs.join(s("i"), "trace").filter("i between f_i and l_i").join(s("j"), "trace").filter("j between f_j and l_j")
    return out.drop("f_i", "l_i", "f_j", "l_j")


def segments_of(rows: DataFrame, segments: DataFrame, place: str = "locus") -> DataFrame:
    """Rows with the segment (first, last; both included) that holds their place: one lookup a row, before any pairing."""
    s = segments.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("first", "last", "segment"))).alias("_s"))
    hit = F.get(F.filter("_s", lambda x: (x["first"] <= F.col(place)) & (x["last"] >= F.col(place))), F.lit(0))
    return rows.join(s, "trace").withColumn("segment", hit["segment"]).drop("_s").filter("segment is not null")


def segment_point_pairs(points: DataFrame, segments: DataFrame) -> DataFrame:
    """trace, i, j, dist, seg_i <= seg_j of all measured pairs i < j: points get their segment first, then meet in their trace."""
    p = segments_of(points.dropna(subset=XYZ), segments)
    side = lambda e: p.select("trace", F.col("locus").alias(e), F.col("segment").alias(f"seg_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in XYZ])
    both = side("i").join(side("j"), "trace").filter("i < j")
    return both.select("trace", "i", "j", "seg_i", "seg_j", distance([F.col(f"{c}_i") for c in XYZ], [F.col(f"{c}_j") for c in XYZ]).alias("dist"))


def domain_distances(seg_pairs: DataFrame, metric: str = "median") -> DataFrame:
    """Distance of every two segments a < b of a trace, from the distances between them against those within either.

    median, mean: difference of the middles over the root of the summed spreads; ks: signed statistic; insulation: median between over
    median within; absolute_median: difference of the medians.  0 if either side has no distances; null where a spread is 0."""
    between = seg_pairs.filter("seg_i < seg_j").groupBy("trace", F.col("seg_i").alias("a"), F.col("seg_j").alias("b")).agg(F.collect_list("dist").alias("_b"))
    within = seg_pairs.filter("seg_i = seg_j").groupBy("trace", F.col("seg_i").alias("s")).agg(F.collect_list("dist").alias("d"))
    out = between
    for e in "ab":
        out = out.join(within.select("trace", F.col("s").alias(e), F.col("d").alias(f"_{e}{e}")), ["trace", e], "left")
    none = F.array().cast("array<double>")
    out = out.withColumn("_w", F.concat(F.coalesce("_aa", none), F.coalesce("_bb", none)))
    b, w = F.col("_b"), F.col("_w")
    value = {
        "median": lambda: effect_of(b, w, median_of),
        "mean": lambda: effect_of(b, w, mean_of),
        "ks": lambda: ks_of(b, w),
        "insulation": lambda: F.try_divide(median_of(b), median_of(w)),
        "absolute_median": lambda: median_of(b) - median_of(w),
    }[metric]()
    return out.select("trace", "a", "b", F.when((F.size(b) < 1) | (F.size(w) < 1), F.lit(0.0)).otherwise(value).alias("domain_dist"))


def domain_contacts(seg_pairs: DataFrame, cutoff: float) -> DataFrame:
    """Share of measured distances at most the cutoff, by segment pair."""
    return seg_pairs.groupBy("seg_i", "seg_j").agg(F.try_divide(F.count_if(F.col("dist") <= cutoff).cast("double"), F.count("dist")).alias("contact"))


def merged_cuts(d: np.ndarray, corr: np.ndarray, cuts: list[int], most_distance: float, most_correlation: float, flexible: float) -> list[int]:
    """The starts of domains that stay when boundaries of a distance map and a correlation map are dropped one at a time."""
    cuts = list(cuts)

    def effect(a: int, m: int, b: int) -> float:
        across = d[a:m, m:b].ravel()
        inner = np.concatenate([d[a:m, a:m][np.triu_indices(m - a, 1)], d[m:b, m:b][np.triu_indices(b - m, 1)]])
        across, inner = across[~np.isnan(across)], inner[~np.isnan(inner)]
        if not len(across) or not len(inner):
            return 0.0
        one, two = np.median(across), np.median(inner)
        spread = np.median((across - one) ** 2) + np.median((inner - two) ** 2)
        return max(float((one - two) / np.sqrt(spread)), 0.0) if spread else 0.0

    while len(cuts) > 1:
        edges = [*cuts, len(d)]
        rows = [corr[a:b].mean(0) for a, b in zip(edges, edges[1:], strict=False)]
        near = np.array([effect(*edges[k - 1 : k + 2]) for k in range(1, len(cuts))])
        alike = np.array([float(np.sqrt(((u - v) ** 2).sum())) / len(d) for u, v in zip(rows, rows[1:], strict=False)])
        may = np.zeros(len(near), bool)
        for up, down in ((0, 0), (flexible, -flexible), (-flexible, flexible)):
            may |= (near <= most_distance * (1 + up)) & (alike <= most_correlation * (1 + down))
        if not may.any():
            break
        cost = np.where(may, near / most_distance + alike / most_correlation, np.inf)
        del cuts[int(np.argmin(cost)) + 1]
    return cuts


def merged_domains(points: DataFrame, size: int, most_distance: float = 0.8, most_correlation: float = 0.05, flexible: float = 0.2, starts: DataFrame | None = None) -> DataFrame:
    """Segments of each trace: start from runs of ``size`` loci (or the segments ``starts``) and drop boundaries one at a time.  A boundary can go if the segments
    beside it are near both by distance (median effect, not below 0) and by correlation (distance of their mean rows in the
    correlation map of the interpolated trace, over its loci), or if one of the two is ``flexible`` below its bound and the other no
    more than that above; of these the one with the least sum of both over their bounds goes.  Sequential by nature, so a
    grouped-map function; a trace fits in a task."""

    def merge(pdf: pd.DataFrame, given: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("locus")
        xyz, loci = pdf[["z", "x", "y"]].to_numpy(float), pdf["locus"].to_numpy()
        good = ~np.isnan(xyz).any(1)
        if good.sum() < 2:
            return pd.DataFrame({"trace": [], "segment": [], "first": [], "last": []})
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        whole = np.column_stack([filled(xyz[:, k]) for k in range(3)])
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.corrcoef(np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1)))
        cuts = list(range(0, len(loci), size)) if given is None else sorted(np.searchsorted(loci, given["first"]).tolist())

        cuts = merged_cuts(d, corr, cuts, most_distance, most_correlation, flexible)
        edges = [*cuts, len(loci)]
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "segment": range(len(cuts)), "first": loci[cuts], "last": loci[np.array(edges[1:]) - 1]})

    schema, rows = "trace long, segment long, first long, last long", points.select("trace", "locus", "z", "x", "y").groupBy("trace")
    return rows.applyInPandas(lambda pdf: merge(pdf), schema) if starts is None else rows.cogroup(starts.groupBy("trace")).applyInPandas(lambda pdf, given: merge(pdf, given), schema)


def filled(v: np.ndarray) -> np.ndarray:
    """Gaps filled linearly; beyond the ends the line through the two nearest values goes on."""
    at = np.flatnonzero(~np.isnan(v))
    out = np.interp(np.arange(len(v)), at, v[at])
    for ends, beyond in ((at[:2], np.arange(at[0])), (at[-2:], np.arange(at[-1] + 1, len(v)))):
        slope = (v[ends[1]] - v[ends[0]]) / (ends[1] - ends[0])
        out[beyond] = v[ends[0]] + slope * (beyond - ends[0])
    return out


def purity(rows: DataFrame, by: list[str], member: Column) -> DataFrame:
    """Share of a segment's loci that belong to a class."""
    return rows.groupBy(*by).agg(F.avg(member.cast("double")).alias("purity"))
