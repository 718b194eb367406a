"""Filters and masks of spots and probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance
from quillspan.operators.significance import group_quantiles


def masked(rows: DataFrame, keep: Column, values: list[str]) -> DataFrame:
    """Values set to null where the condition does not hold."""
    return rows.select(*[F.when(keep, F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def brightest(rows: DataFrame, by: list[str], value: str, threshold: float, least: int, tie: str) -> DataFrame:
    """Rows at or above the threshold, and more of the greatest where a group would keep fewer than ``least`` (soft threshold; 0 is hard)."""
    w = W.partitionBy(*by)
    enough = F.greatest(F.count_if(F.col(value) >= threshold).over(w), F.lit(least))
    return rows.withColumn("_n", enough).withColumn("_r", F.row_number().over(w.orderBy(F.desc(value), tie))).filter("_r <= _n").drop("_n", "_r")


def in_ranges(rows: DataFrame, ranges: dict[str, tuple[float, float]], differences: list[tuple[str, str, float]] = ()) -> DataFrame:
    """Rows whose columns lie in their closed ranges and whose named pairs differ by no more than the given amount."""
    good = F.lit(True)
    for c, (low, high) in ranges.items():
        good = good & F.col(c).between(low, high)
    for a, b, most in differences:
        good = good & (F.abs(F.col(a) - F.col(b)) <= most)
    return rows.filter(good)


def without_caps(rows: DataFrame, by: list[str], value: str, share: float = 0.995) -> DataFrame:
    """The value, null above the group's quantile, as ``capped``."""
    q = group_quantiles(rows, by, value, {"_q": share})
    return rows.join(q, by).withColumn("capped", F.when(F.col(value) <= F.col("_q"), F.col(value))).drop("_q")


def scaled(rows: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The value clipped to the group's percentiles and brought to 0 .. 1; null where both are equal."""
    q = group_quantiles(rows, by, value, {"_l": low, "_h": high})
    clipped = F.least(F.greatest(F.col(value), "_l"), "_h")
    return rows.join(q, by).withColumn("scaled", F.try_divide(clipped - F.col("_l"), F.col("_h") - F.col("_l"))).drop("_l", "_h")


def sparse_centres(points: DataFrame, by: str, order: str, axes: list[str], reach: float, norm: str = "box") -> DataFrame:
    """by, order of the points kept when each, in order, is dropped if it lies within the reach of one kept before.  Depends on the
    order, so it is a grouped-map function; a group is the spots of one image."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(order)
        xyz, kept = pdf[axes].to_numpy(float), []
        for i in range(len(xyz)):
            off = np.abs(xyz[kept] - xyz[i])
            near = off.max(1) if norm == "box" else np.sqrt((off**2).sum(1))
            if not kept or near.min() > reach:
                kept.append(i)
        return pdf.iloc[kept][[by, order]]

    return points.select(by, order, *axes).groupBy(by).applyInPandas(keep, f"{by} {dict(points.dtypes)[by]}, {order} {dict(points.dtypes)[order]}")


def steady(moves: DataFrame, by: list[str], id_: str, axes: list[str], shift: list[str], neighbours: int, sigmas: float) -> DataFrame:
    """Moves that agree with the moves beside them: by distance from the mean move of the nearest others, weighted by inverse distance,
    below the group's mean plus ``sigmas`` population deviations."""
    a = moves.select(*by, F.col(id_).alias("_i"), *[F.col(c).alias(f"{c}_a") for c in axes])
    b = moves.select(*by, F.col(id_).alias("_j"), *[F.col(c).alias(f"{c}_b") for c in axes], *shift)
    d = distance([F.col(f"{c}_a") for c in axes], [F.col(f"{c}_b") for c in axes])
    near = a.join(b, by).filter("_i <> _j").withColumn("_d", d)
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_i").orderBy("_d", "_j"))).filter(F.col("_r") <= neighbours)
    weight = 1 / F.greatest(F.col("_d"), F.lit(1e-9))
    mean = near.groupBy(*by, F.col("_i").alias(id_)).agg(*[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(f"_m_{c}") for c in shift])
    off = moves.join(mean, [*by, id_]).withColumn("off", distance([F.col(c) for c in shift], [F.col(f"_m_{c}") for c in shift]))
    w = W.partitionBy(*by)
    limit = F.avg("off").over(w) + sigmas * F.stddev_pop("off").over(w)
    return off.withColumn("_l", limit).filter("off < _l").drop("_l", *[f"_m_{c}" for c in shift])
