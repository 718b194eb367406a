"""Picks of one spot a region: over all traces with shared references, and for a cell's homologs together.

Both go in rounds: references are measured on the picks, candidates are scored against them, and the best are picked again.  They end
after ``rounds``, when the share of picks that moved is below ``least_change``, or when it goes up and down near it: more than five
rounds, the last five moving no more than twice ``least_change`` in the mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance
from quillspan.operators.significance import range_ends, running

XYZ = ["z", "x", "y"]


def ended(moved: list[float], rounds: int, least_change: float) -> str | None:
    """Why the rounds end, if they do."""
    if moved and moved[-1] < least_change:
        return "settled"
    if len(moved) > 5 and sum(moved[-5:]) / 5 <= 2 * least_change:
        return "oscillates"
    return "rounds" if len(moved) >= rounds else None


def _features(rows: DataFrame, picks: DataFrame, reach: int) -> DataFrame:
    """Rows with ``_ct``, the distance from the centre of their trace's picks, and ``_lc``, that from the centre of the picks at most ``reach``
    loci away, their own locus left out (null without any)."""
    centre = picks.groupBy("trace").agg(*[F.avg(c).alias(f"_c{c}") for c in XYZ])
    w = W.partitionBy("trace").orderBy("locus")
    near = [w.rangeBetween(-reach, -1), w.rangeBetween(1, reach)]
    total = lambda c: F.coalesce(F.sum(c).over(near[0]), F.lit(0.0)) + F.coalesce(F.sum(c).over(near[1]), F.lit(0.0))
    n = F.count("z").over(near[0]) + F.count("z").over(near[1])
    local = picks.select("trace", "locus", *[F.try_divide(total(c), n).alias(f"_l{c}") for c in XYZ])
    both = rows.join(centre, "trace").join(local, ["trace", "locus"])
    at = [F.col(c) for c in XYZ]
    both = both.withColumn("_ct", distance(at, [F.col(f"_c{c}") for c in XYZ])).withColumn("_lc", distance(at, [F.col(f"_l{c}") for c in XYZ]))
    return both.drop(*[f"_{k}{c}" for k in "cl" for c in XYZ])


def _share(scored: DataFrame, value: str, ends: list[float]) -> DataFrame:
    """_key, value and the share of the known values of the key's picks that are at most the value."""
    run = running(scored.filter(F.col(value).isNotNull()), ["_key"], value, {"n": F.count_if("picked")}, ends=ends)
    return run.select(F.col("_key").alias(f"_k_{value}"), F.col(value).alias(f"_v_{value}"), F.try_divide("run_n", "all_n").alias(f"share_{value}"))


def pick_in_population(candidates: DataFrame, rounds: int = 10, least_change: float = 0.0025, by_region: bool = False, reach: int = 5) -> tuple[DataFrame, list[float], str]:
    """Picks of candidates(trace, locus, candidate, z, x, y, brightness) with ``score``, the shares of picks that moved, and why it ended.

    The first picks are the brightest.  References are the brightness, the distance from the trace's centre and that from the local centre of all traces' picks, of
    one pool or (``by_region``) by locus.  A candidate's score is the share of the pool that is no brighter, times the shares that are farther from either
    centre (1 where there is no local centre); the greatest is picked (ties: least candidate).  Candidates without a place or brightness take no part.  Each
    round is DataFrame work, written to cut its lineage."""
    from quillspan.sources.files import written

    rows = written(candidates.dropna(subset=[*XYZ, "brightness"]).select("trace", "locus", "candidate", *XYZ, F.col("brightness").cast("double").alias("brightness")).withColumn("_key", F.col("locus").cast("long") if by_region else F.lit(0).cast("long")))
    w = W.partitionBy("trace", "locus")
    best = lambda df, score: df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), "candidate"))).filter("_r = 1").drop("_r")
    picks, moved, why = written(best(rows, "brightness").withColumn("score", F.lit(None).cast("double"))), [], ended([], rounds, least_change)
    while why is None:
        now = picks.select("trace", "locus", "candidate", F.lit(True).alias("picked"))
        scored = written(_features(rows, picks, reach).join(now, ["trace", "locus", "candidate"], "left").withColumn("picked", F.coalesce("picked", F.lit(False))))
        shares = {v: _share(scored, v, ends) for v, ends in range_ends(scored, ["brightness", "_ct", "_lc"]).items()}
        for v, share in shares.items():
            scored = scored.join(share, F.col("_key").eqNullSafe(F.col(f"_k_{v}")) & (F.col(v) == F.col(f"_v_{v}")), "left").drop(f"_k_{v}", f"_v_{v}")
        score = F.col("share_brightness") * (1 - F.col("share__ct")) * F.coalesce(1 - F.col("share__lc"), F.lit(1.0))
        new = written(best(scored.withColumn("score", score), "score").select(*rows.columns, "score"))
        both = new.select("trace", "locus", F.col("candidate").alias("_n")).join(picks.select("trace", "locus", "candidate"), ["trace", "locus"])
        moved.append(both.agg(F.avg((F.col("_n") != F.col("candidate")).cast("double"))).first()[0] or 0.0)
        picks, why = new, ended(moved, rounds, least_change)
    return picks.drop("_key"), moved, why


def joint_chain(places: list[np.ndarray], scores: list[np.ndarray], gaps: list[int], weights: np.ndarray, missing: float = -1000.0, share: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """The best sum and, for each region, the candidates of two chains (-1: none, at ``missing``).

    ``scores`` has a row for each candidate and a column for each chain; going on from one place to the next costs the chain's weight times the distance over the
    gap, nothing to or from none.  The chains may not have the same candidate unless they ``share``.  All pairs are kept, so the result is the best of all; a step
    goes over one chain at a time, so it takes (candidates + 1)**3 steps, not **4."""

    def own(s: np.ndarray) -> np.ndarray:
        out = np.full((len(s) + 1, len(s) + 1), -np.inf)
        out[:-1, :-1] = s[:, :1] + s[None, :, 1]
        if not share:
            out[range(len(s)), range(len(s))] = -np.inf
        out[:-1, -1], out[-1, :-1], out[-1, -1] = s[:, 0] + missing, s[:, 1] + missing, 2 * missing
        return out

    total, back = own(scores[0]), []
    for k in range(1, len(places)):
        d = np.zeros((len(places[k - 1]) + 1, len(places[k]) + 1))
        d[:-1, :-1] = np.sqrt(((places[k - 1][:, None] - places[k][None]) ** 2).sum(-1)) / max(gaps[k - 1], 1)
        first = total[:, None, :] - weights[0] * d[:, :, None]  # was a, is a2, was b
        a = first.argmax(0)
        second = first.max(0)[:, :, None] - weights[1] * d[None]  # is a2, was b, is b2
        b = second.argmax(1)
        back.append((a, b))
        total = second.max(1) + own(scores[k])
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    best, path = float(total[i, j]), [(int(i), int(j))]
    for a, b in reversed(back):
        j = b[path[-1][0], path[-1][1]]
        path.append((int(a[path[-1][0], j]), int(j)))
    path.reverse()
    return best, [tuple(x if x < len(p) else -1 for x in pair) for pair, p in zip(path, places, strict=True)]


def _median(v: np.ndarray) -> float:
    v = v[~np.isnan(v)]
    return float(np.median(v)) if len(v) and np.median(v) > 0 else np.inf


def _scores(places, bright, loci, picks, centres, local: int, weights: dict[str, float]) -> tuple[list[np.ndarray], np.ndarray]:
    """Scores of the candidates for each of two chains against their picks, and the weights of the chains' steps."""
    out = [np.zeros((len(p), 2)) for p in places]
    steps = np.zeros(2)
    for h in range(2):
        at = np.array([places[k][c[h]] if c[h] >= 0 else [np.nan] * 3 for k, c in enumerate(picks)])
        shone = np.array([bright[k][c[h]] if c[h] >= 0 else np.nan for k, c in enumerate(picks)])
        near = np.array([np.nanmean(at[m], 0) if (m := (np.abs(loci - loci[k]) <= local) & (loci != loci[k]) & ~np.isnan(at[:, 0])).any() else [np.nan] * 3 for k in range(len(at))])
        far, off = np.sqrt(((at - centres[h]) ** 2).sum(1)), np.sqrt(((at - near) ** 2).sum(1))
        known = np.flatnonzero(~np.isnan(at[:, 0]))
        go = np.sqrt((np.diff(at[known], axis=0) ** 2).sum(1)) if len(known) > 1 else np.zeros(0)
        ct, lc, light, step = _median(far), _median(off), _median(shone), _median(go)
        steps[h] = weights["step"] / step
        for k, p in enumerate(places):
            if not len(p):
                continue
            s = -weights["centre"] * np.sqrt(((p - centres[h]) ** 2).sum(1)) / ct
            if not np.isnan(near[k]).any():
                s = s - weights["local"] * np.sqrt(((p - near[k]) ** 2).sum(1)) / lc
            if np.isfinite(light):
                s = s + weights["bright"] * np.log(bright[k] / (bright[k] + light))
            out[k][:, h] = s
    return out, steps


def pick_homologs(candidates: DataFrame, centres: DataFrame, rounds: int = 10, least_change: float = 0.0025, local: int = 5, weights: dict[str, float] | None = None, share: bool = False) -> DataFrame:
    """cell, homolog, locus, candidate, ``rounds`` and ``why`` they ended, of candidates(cell, locus, candidate, z, x, y, brightness > 0) and the places of each cell's two
    homologs, centres(cell, homolog, z, x, y).

    The first picks are those nearest to the centres, as one joint chain without steps.  Then, each round, candidates score by their distances from the homolog's
    centre and from the mean of its picks at most ``local`` loci away, each over the median of the picks, and by ln(b / (b + median brightness)); the joint chain
    of the best sum, with steps over the picks' median step and the loci's gap, is picked.  No spot goes to both homologs unless they ``share``.  Where
    there are fewer candidates than homologs, one has no row.  A cell's chains need its regions in order: a grouped-map function over a cell."""
    w = {"centre": 2.0, "local": 1.0, "bright": 1.0, "step": 2.0} | (weights or {})

    def work(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        at, pdf = at.sort_values("homolog"), pdf.dropna().sort_values(["locus", "candidate"])
        if len(at) != 2 or not len(pdf):
            return pd.DataFrame({"cell": [], "homolog": [], "locus": [], "candidate": [], "rounds": [], "stopped": []})
        groups = [g for _, g in pdf.groupby("locus")]
        loci, home = np.array([g["locus"].iloc[0] for g in groups]), at[XYZ].to_numpy(float)
        places, bright = [g[XYZ].to_numpy(float) for g in groups], [g["brightness"].to_numpy(float) for g in groups]
        gaps = np.diff(loci).tolist()
        first = [-np.sqrt(((p[:, None] - home[None]) ** 2).sum(-1)) for p in places]
        _, picks = joint_chain(places, first, gaps, np.zeros(2), -1e6, share)
        moved, why = [], ended([], rounds, least_change)
        while why is None:
            scores, steps = _scores(places, bright, loci, picks, home, local, w)
            _, new = joint_chain(places, scores, gaps, steps, share=share)
            moved.append(float(np.mean([a != b for x, y in zip(new, picks, strict=True) for a, b in zip(x, y, strict=True)])))
            picks, why = new, ended(moved, rounds, least_change)
        out = [(pdf["cell"].iloc[0], at["homolog"].iloc[h], loci[k], groups[k]["candidate"].iloc[c[h]], len(moved), ("settled", "oscillates", "rounds").index(why)) for k, c in enumerate(picks) for h in range(2) if c[h] >= 0]
        return pd.DataFrame(out, columns=["cell", "homolog", "locus", "candidate", "rounds", "stopped"])

    rows = candidates.select("cell", "locus", "candidate", *XYZ, F.col("brightness").cast("double").alias("brightness"))
    found = rows.groupBy("cell").cogroup(centres.dropna().select(F.col("cell").alias("of"), "homolog", *XYZ).groupBy("of")).applyInPandas(work, "cell long, homolog long, locus long, candidate long, rounds int, stopped int")
    return found.withColumn("why", F.element_at(F.array(F.lit("settled"), F.lit("oscillates"), F.lit("rounds")), F.col("stopped") + 1)).drop("stopped")


