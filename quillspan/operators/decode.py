"""Choosing among candidate spots: chains, matching, tiling and iterative refinement.

These depend on an order or on what was chosen before, so each runs as a grouped-map function whose group (a trace, a cell, a
region) is bounded by the experiment; the reference distributions that they share are DataFrame aggregates.
"""

from __future__ import annotations

import functools
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rescaled_cdf(reference: np.ndarray, values: np.ndarray, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """Share of the reference at most each value, rescaled so that ``low`` is 0 and ``high`` is 1; nan counts as infinity."""
    r = np.sort(reference[~np.isnan(reference)])
    share = lambda v: np.searchsorted(r, np.where(np.isnan(v), np.inf, v), side="right") / max(len(r), 1)
    least, most = share(np.array(low)), share(np.array(high))
    return np.clip((share(values) - least) / (most - least if most > least else 1), 0, 1)


def best_chain(candidates: DataFrame, steps: DataFrame, weight: float = 1.0, low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """One candidate for each locus of a trace: greatest sum of scores and, between loci that follow each other, of weight * ln(1 - cdf of
    their distance) / (difference of their ids).  The cdf is that of the trace's reference distances steps(trace, dist), rescaled
    between low and high.  Sequential by nature (dynamic programming), so a grouped-map function over a trace."""

    def pick(pdf: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"trace": [], "locus": [], "candidate": [], "score": []})
        pdf, known = pdf.sort_values(["locus", "candidate"]), reference["dist"].to_numpy(float)
        levels = [(k, g) for k, g in pdf.groupby("locus", sort=True)]
        best, back = levels[0][1]["score"].to_numpy(float), []
        for (k0, prev), (k1, here) in zip(levels, levels[1:], strict=False):
            a, b = prev[["z", "x", "y"]].to_numpy(float), here[["z", "x", "y"]].to_numpy(float)
            with np.errstate(divide="ignore"):
                link = weight * np.log(1 - rescaled_cdf(known, np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), low, high)) / (k1 - k0)
            total = best[:, None] + link
            back.append(total.argmax(0))
            best = total.max(0) + here["score"].to_numpy(float)
        at = int(best.argmax())
        chosen = [at]
        for step in reversed(back):
            at = int(step[at])
            chosen.append(at)
        rows = [g.iloc[[i]] for (_, g), i in zip(levels, reversed(chosen), strict=True)]
        return pd.concat(rows)[["trace", "locus", "candidate", "score"]]

    return candidates.groupBy("trace").cogroup(steps.select("trace", "dist").groupBy("trace")).applyInPandas(pick, "trace long, locus long, candidate long, score double")


def greedy_match(pairs: DataFrame, by: str) -> DataFrame:
    """Pairs in order of dist (ties: a, then b), each end used once."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a_used, b_used, keep = set(), set(), []
        for i, (a, b) in zip(*[(o := pdf.sort_values(["dist", "a", "b"])).index, zip(o["a"], o["b"], strict=True)], strict=True):
            if a not in a_used and b not in b_used:
                a_used.add(a)
                b_used.add(b)
                keep.append(i)
        return pdf.loc[keep]

    return pairs.select(by, "a", "b", "dist").groupBy(by).applyInPandas(match, f"{by} long, a long, b long, dist double")


def aligned_in_order(pairs: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b) within reach that are kept when the a are taken in order and one is matched if exactly one b that is not yet used lies
    within its reach.  Depends on the order, so it is a grouped-map function."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for _, own in pdf.sort_values(["a", "b"]).groupby("a", sort=True):
            free = [(i, b) for i, b in zip(own.index, own["b"], strict=True) if b not in used]
            if len(free) == 1:
                used.add(free[0][1])
                keep.append(free[0][0])
        return pdf.loc[keep]

    return pairs.select(by, "a", "b", "dist").groupBy(by).applyInPandas(match, f"{by} long, a long, b long, dist double")


def without_overlaps(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Intervals left when, from the left, the earlier of two neighbours that overlap is dropped until none do."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for i, s, e in sorted(zip(pdf.index, pdf[start], pdf[end], strict=True), key=lambda x: (x[1], x[2])):
            while kept and s < kept[-1][2]:
                kept.pop()
            kept.append((i, s, e))
        return pdf.loc[[i for i, *_ in kept]]

    return rows.select(by, start, end).groupBy(by).applyInPandas(walk, f"{by} long, {start} long, {end} long")


def tile(rows: DataFrame, by: str, start: str, length: int, gap: int) -> DataFrame:
    """Rows from the left, each beginning at least ``gap`` after the last one kept ends."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, free, keep = pdf.sort_values(start), -np.inf, []
        for i, s in pdf[start].items():
            if s >= free:
                keep.append(i)
                free = s + length + gap
        return pdf.loc[keep]

    return rows.select(by, start).groupBy(by).applyInPandas(walk, f"{by} long, {start} long")


def pick_by_em(candidates: DataFrame, rounds: int = 5, least_change: float = 0.01) -> tuple[DataFrame, list[float]]:
    """Best candidate by trace and locus, where the score is the cdf of brightness less that of the distance from the trace's median
    of picks; picks and cdfs are refreshed in turn.  Each round is DataFrame work, written to the shared folder to cut its lineage."""
    from quillspan.sources.files import written

    w = W.partitionBy("trace", "locus").orderBy(F.desc("score"), "candidate")
    picks = written(candidates.withColumn("score", F.cume_dist().over(W.partitionBy("trace").orderBy("brightness"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"))
    moved = []
    for _ in range(rounds):
        centre = picks.groupBy("trace").agg(*[F.median(c).alias(f"{c}_m") for c in ("z", "x", "y")])
        near = F.sqrt(sum(((F.col(c) - F.col(f"{c}_m")) ** 2 for c in ("z", "x", "y")), F.lit(0.0)))
        scored = candidates.join(centre, "trace").withColumn("_d", near)
        by = W.partitionBy("trace")
        scored = scored.withColumn("score", F.cume_dist().over(by.orderBy("brightness")) - F.cume_dist().over(by.orderBy("_d")))
        new = written(scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*candidates.columns, "score"))
        both = new.select("trace", "locus", F.col("candidate").alias("n")).join(picks.select("trace", "locus", "candidate"), ["trace", "locus"])
        moved.append(both.agg(F.avg((F.col("n") != F.col("candidate")).cast("double"))).first()[0] or 0.0)
        picks = new
        if moved[-1] < least_change:
            break
    return picks, moved


def first_component(matrix: DataFrame, rounds: int = 200) -> DataFrame:
    """First principal component of each group's rows (i, j, r) of a symmetric matrix with ones on the diagonal, by power iteration,
    oriented so that its greatest entry by size is positive."""

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf[["i", "j"]].to_numpy())
        m = np.eye(len(names))
        a, b = np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])
        m[a, b] = m[b, a] = pdf["r"].fillna(0)
        m = m - m.mean(0)
        v = np.linspace(1, 2, len(names))
        for _ in range(rounds):
            v = m.T @ (m @ v)
            v /= np.linalg.norm(v) or 1
        v *= np.sign(v[np.abs(v).argmax()]) or 1
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "locus": names, "pc1": v})

    return matrix.groupBy("trace").applyInPandas(power, "trace long, locus long, pc1 double")


def first_component_of(points: DataFrame, axes: list[str]) -> DataFrame:
    """The same for the correlations of each two points over their axes, without the matrix: with the centred and scaled points as
    rows of U, it is U U' (constant points correlate with nothing; one more axis stands for their ones on the diagonal), so its
    component comes from a matrix as small as the axes are many.  Points with a null axis take no part."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("locus")
        if pdf.empty:
            return pd.DataFrame({"trace": [], "locus": [], "pc1": []})
        u = pdf[axes].to_numpy(float)
        constant = (u == u[:, :1]).all(1)
        u = np.where(constant[:, None], 0, u - u.mean(1, keepdims=True))
        u = u / np.where(constant, 1, np.sqrt((u * u).sum(1)))[:, None]
        u = np.column_stack([u, constant / np.sqrt(max(constant.sum(), 1))])
        q, s, _ = np.linalg.svd(u, full_matrices=False)
        mean = q.mean(0)
        small = (s * s)[:, None] * (q.T @ q - len(q) * np.outer(mean, mean)) * (s * s)
        v = q @ np.linalg.eigh(small)[1][:, -1]
        v *= np.sign(v[np.abs(v).argmax()]) or 1
        return pd.DataFrame({"trace": pdf["trace"], "locus": pdf["locus"], "pc1": v})

    return points.select("trace", "locus", *axes).groupBy("trace").applyInPandas(solve, "trace long, locus long, pc1 double")


def in_hulls(points: np.ndarray, vertices: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Whether the convex hull of each row of vertices (n, k, 3) holds its point: von Neumann's search for a plane that parts them, of all
    rows at once; those that are decided drop out."""
    v = vertices - points[:, None]
    w, at, out = v.mean(1), np.arange(len(v)), np.zeros(len(points), bool)
    dot = lambda a, b: (a * b).sum(1)
    near = lambda v, w: dot(w, w) < 1e-9 * (v * v).sum(2).max(1)
    for _ in range(rounds):
        norm = dot(w, w)
        far = v[np.arange(len(v)), np.argmin(np.einsum("nki,ni->nk", v, w), axis=1)] if len(v) else w
        inside = norm < 1e-18
        out[at[inside]] = True
        on = ~inside & ~(dot(far, w) > 0)
        v, w, at, norm, far = v[on], w[on], at[on], norm[on], far[on]
        if not len(at):
            return out
        step = w - far
        w = w - step * np.minimum(1.0, dot(w, step) / dot(step, step))[:, None]
        still = norm - dot(w, w) < 1e-15 * norm
        out[at[still]] = near(v[still], w[still])
        v, w, at = v[~still], w[~still], at[~still]
    if len(at):
        out[at] = near(v, w)
    return out


def in_hull(point: np.ndarray, vertices: np.ndarray, rounds: int = 300) -> bool:
    """Whether the convex hull of the vertices holds the point."""
    return bool(in_hulls(point[None], vertices[None], rounds)[0])


@functools.lru_cache(1 << 16)
def _drawn(seed: int, locus: int, n: int, size: int) -> np.ndarray:
    """Places of a seeded sample of ``size`` of n; traces with as many members draw the same."""
    return np.random.default_rng([seed, locus]).choice(n, size, replace=False)


def inside_hull(points: DataFrame, group: str, size: int, times: int) -> DataFrame:
    """By trace, locus and group: the share of ``times`` seeded samples of ``size`` points of the group (the point itself left out)
    whose convex hull holds the point.  Samples of 3 points or fewer hold nothing; groups too small for a sample are null."""

    def boot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["z", "x", "y"]).sort_values("locus")
        xyz, of, loci = pdf[["z", "x", "y"]].to_numpy(float), pdf[group].to_numpy(), pdf["locus"].tolist()
        out = []
        for g in sorted(set(of)):
            members = np.flatnonzero(of == g)
            for low in range(0, len(pdf), 1024):
                rows = range(low, min(low + 1024, len(pdf)))
                others = [members[members != row] for row in rows]
                enough = [i for i, o in enumerate(others) if len(o) >= size]
                share = np.zeros(len(enough))
                if size > 3 and enough:
                    picks = np.array([others[i][_drawn(t, int(loci[low + i]), len(others[i]), size)] for i in enough for t in range(times)])
                    at = np.repeat(low + np.array(enough), times)
                    share = in_hulls(xyz[at], xyz[picks]).reshape(-1, times).mean(1)
                inside = dict(zip(enough, share.tolist(), strict=True))
                out += [(pdf["trace"].iloc[0], loci[row], g, inside.get(row - low)) for row in rows]
        return pd.DataFrame(out, columns=["trace", "locus", "group", "inside"])

    return points.select("trace", "locus", "z", "x", "y", group).groupBy("trace").applyInPandas(boot, "trace long, locus long, group string, inside double")
