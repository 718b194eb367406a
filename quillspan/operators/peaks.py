"""Peaks, runs and smoothing along a trace."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def peak_places(v: np.ndarray, distance: int = 1, prominence: float = 0.0, width: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, prominences and half-height widths of the local maxima of v (of a plateau its middle, rounded down; the ends are none).

    First maxima closer than ``distance`` to a higher one go (of equals, the later one stays), then those with less prominence, then
    those narrower than ``width`` at half their prominence."""
    places, n = [], len(v)
    i = 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            end = i + 1
            while end < n - 1 and v[end] == v[i]:
                end += 1
            if v[end] < v[i]:
                places.append((i + end - 1) // 2)
                i = end
        i += 1
    at = np.array(places, int)
    stay = np.ones(len(at), bool)
    for k in np.argsort(v[at], kind="stable")[::-1]:
        if stay[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            stay &= ~near
    at = at[stay]
    height, wide = np.zeros(len(at)), np.zeros(len(at))
    for k, p in enumerate(at):
        left, right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
        low, high = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] - 1 if len(right) else n - 1)
        height[k] = v[p] - max(v[low : p + 1].min(), v[p : high + 1].min())
        half = v[p] - height[k] / 2
        a, b = p, p
        while a > low and v[a] > half:
            a -= 1
        while b < high and v[b] > half:
            b += 1
        start = a + (half - v[a]) / (v[a + 1] - v[a]) if v[a] < half else a
        stop = b - (half - v[b]) / (v[b - 1] - v[b]) if v[b] < half else b
        wide[k] = stop - start
    good = (height >= prominence) & (wide >= width)
    return at[good], height[good], wide[good]


def find_peaks(rows: DataFrame, value: str, distance: int = 1, prominence: float = 0.0, width: float = 0.0, by: str = "trace", order: str = "locus") -> DataFrame:
    """by, order, prominence and width of the peaks of each trace.  What is near and prominent depends on the whole trace, so it is a
    grouped-map function."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(order)
        at, height, wide = peak_places(pdf[value].to_numpy(float), distance, prominence, width)
        return pd.DataFrame({by: pdf[by].to_numpy()[at], order: pdf[order].to_numpy()[at], "prominence": height, "width": wide})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, value).groupBy(by).applyInPandas(work, f"{by} {kinds[by]}, {order} {kinds[order]}, prominence double, width double")


def flipped(labels: np.ndarray, least: int) -> np.ndarray:
    """0/1 labels after flipping the shortest run (the first of equals) again and again until all have ``least`` or there is one run."""
    labels = labels.copy()
    while len(labels):
        edge = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        size = np.diff(np.append(edge, len(labels)))
        if size.min() >= least or len(size) == 1:
            break
        k = int(size.argmin())
        labels[edge[k] : edge[k] + size[k]] = 1 - labels[edge[k]]
    return labels


def without_small_runs(rows: DataFrame, label: str, least: int, by: str = "trace", order: str = "locus") -> DataFrame:
    """by, order and the label (0 or 1) after small runs are flipped.  Each flip depends on the last: a grouped-map function."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(order)
        return pd.DataFrame({by: pdf[by], order: pdf[order], label: flipped(pdf[label].to_numpy(int), least)})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, F.col(label).cast("int").alias(label)).groupBy(by).applyInPandas(work, f"{by} {kinds[by]}, {order} {kinds[order]}, {label} int")


def smoothed(rows: DataFrame, value: str, sigma: float, by: str = "trace", order: str = "locus") -> DataFrame:
    """The Gaussian-weighted mean of the measured values around each row (reach 4 sigma, mirrored at the ends), as ``smooth``.  Rows go to
    the places that they reach, so the cost is linear; a trace must be longer than the reach."""
    reach = int(4 * sigma + 0.5)
    w = W.partitionBy(by)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    seen = placed.filter(F.col(value).isNotNull()).select(by, F.col("_i").alias("_j"), "_n", F.col(value).alias("_v"))
    own = F.array(F.col("_j"), -1 - F.col("_j"), 2 * F.col("_n") - 1 - F.col("_j"))  # itself and its mirror images
    dealt = seen.select(by, "_v", "_n", F.explode(own).alias("_m")).select(by, "_v", "_m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_m") - reach), F.least(F.col("_n") - 1, F.col("_m") + reach), F.when(F.greatest(F.lit(0), F.col("_m") - reach) <= F.least(F.col("_n") - 1, F.col("_m") + reach), 1).otherwise(-1))).alias("_i"))
    dealt = dealt.filter(F.abs(F.col("_i") - F.col("_m")) <= reach)
    g = F.exp(-0.5 * (F.col("_i") - F.col("_m")) * (F.col("_i") - F.col("_m")) / (sigma * sigma))
    mean = dealt.groupBy(by, "_i").agg((F.sum(F.col("_v") * g) / F.sum(g)).alias("smooth"))
    return placed.join(mean, [by, "_i"], "left").drop("_i", "_n")
