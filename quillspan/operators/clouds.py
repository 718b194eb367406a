"""Spots as clouds on a grid of voxels, their maxima, and meshes of neighbours.

A cloud is kept sparse: rows (trace, group, vz, vx, vy, density) of the voxels that a spot reaches.  Stamps are added up by key, partly
in each task before the shuffle.  What looks at a voxel's surroundings works on blocks of ``edge`` voxels a side with the rows around them
(halo), so a group of rows is bounded whatever the size of the cloud.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import distance

XYZ = ["z", "x", "y"]
VOXEL = ["vz", "vx", "vy"]


def clouds(points: DataFrame, group: str, voxel: float, sigma: float, reach: int, weight: Column | None = None, normal: str | None = None) -> DataFrame:
    """trace, group, vz, vx, vy and density: each spot adds weight * exp(-d**2 / 2 sigma**2) to the voxels at most ``reach`` voxels from its own
    along each axis; d is the distance of the voxel's centre in voxels.  ``normal``: ``count`` divides by the group's spots, ``pdf`` by its sum."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    spots = points.dropna(subset=XYZ).select("trace", F.col(group).alias("group"), w.alias("_w"), *[(F.col(c) / voxel).alias(c) for c in XYZ])
    for c, v in zip(XYZ, VOXEL, strict=True):
        spots = spots.withColumn(v, F.explode(F.sequence(F.round(c).cast("long") - reach, F.round(c).cast("long") + reach)))
    square = sum(((F.col(v) - F.col(c)) * (F.col(v) - F.col(c)) for c, v in zip(XYZ, VOXEL, strict=True)), F.lit(0.0))
    out = spots.groupBy("trace", "group", *VOXEL).agg(F.sum(F.col("_w") * F.exp(-square / (2 * sigma * sigma))).alias("density"))
    if normal == "count":
        n = points.dropna(subset=XYZ).groupBy("trace", F.col(group).alias("group")).agg(F.count("*").alias("_n"))
        return out.join(n, ["trace", "group"]).withColumn("density", F.col("density") / F.col("_n")).drop("_n")
    if normal == "pdf":
        total = out.groupBy("trace", "group").agg(F.sum("density").alias("_n"))
        return out.join(total, ["trace", "group"]).withColumn("density", F.try_divide("density", "_n")).drop("_n")
    return out


def _slid(a: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """The greatest of the values from ``before`` places back to ``after`` places on, inside the array."""
    out = a.copy()
    for step in range(1, before + 1):
        part = [slice(None)] * 3
        back = list(part)
        part[axis], back[axis] = slice(step, None), slice(None, -step)
        out[tuple(part)] = np.maximum(out[tuple(part)], a[tuple(back)])
    for step in range(1, after + 1):
        part = [slice(None)] * 3
        on = list(part)
        part[axis], on[axis] = slice(None, -step), slice(step, None)
        out[tuple(part)] = np.maximum(out[tuple(part)], a[tuple(on)])
    return out


_SECOND = ["hzz", "hzx", "hzy", "hxx", "hxy", "hyy"]


def window_maxima(cloud: DataFrame, window: int = 10, edge: int = 16) -> DataFrame:
    """The voxels with no denser one from window // 2 before to (window - 1) // 2 after along each axis, with density and its six second differences: those of central
    differences taken twice, unreached voxels counting 0."""
    before, after = window // 2, (window - 1) // 2
    low, high = max(before, 2), max(after, 2)
    rows = cloud.select("trace", "group", *VOXEL, "density")
    for v in VOXEL:
        rows = rows.withColumn(f"b{v}", F.explode(F.sequence(F.floor((F.col(v) - high) / edge), F.floor((F.col(v) + low) / edge))))
    blocks = [f"b{v}" for v in VOXEL]
    side = edge + low + high

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        origin = np.array([int(pdf[b].iloc[0]) * edge - low for b in blocks])
        at = tuple((pdf[VOXEL].to_numpy() - origin).T)
        grid = np.zeros((side,) * 3)
        grid[at] = pdf["density"]
        top = grid
        for axis in range(3):
            top = _slid(top, before, after, axis)
        place = np.stack(at, 1)
        inner = ((place >= low) & (place < low + edge)).all(1)
        p = place[inner & (grid[at] == top[at]) & (grid[at] > 0)]
        value = lambda *steps: grid[tuple((p + sum((np.eye(3, dtype=int)[k] * s for k, s in steps), np.zeros(3, int))).T)]
        out = {v: (p + origin)[:, k] for k, v in enumerate(VOXEL)} | {"density": value()}
        for name, (k, m) in zip(_SECOND, itertools.combinations_with_replacement(range(3), 2), strict=True):
            out[name] = (value((k, 2)) - 2 * value() + value((k, -2))) / 4 if k == m else (value((k, 1), (m, 1)) - value((k, 1), (m, -1)) - value((k, -1), (m, 1)) + value((k, -1), (m, -1))) / 4
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "group": pd.Series([pdf["group"].iloc[0]] * len(p), dtype=object), **out})

    kinds = dict(cloud.dtypes)
    schema = f"trace {kinds['trace']}, group {kinds['group']}, vz long, vx long, vy long, density double, " + ", ".join(f"{h} double" for h in _SECOND)
    return rows.groupBy("trace", "group", *blocks).applyInPandas(work, schema)


def local_maxima(cloud: DataFrame, window: int = 10, share: float = 0.25) -> DataFrame:
    """trace, group, vz, vx, vy and density of the window maxima at which the density bends down in all directions (its matrix of second differences is
    negative definite), with more than ``share`` of the group's greatest maximum."""
    found = window_maxima(cloud, window).withColumn("_top", F.max("density").over(W.partitionBy("trace", "group")))
    a, b, c, d, e, f = (F.col(h) for h in _SECOND)
    second = a * d - b * b
    third = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    return found.filter((a < 0) & (second > 0) & (third < 0) & (F.col("density") > share * F.col("_top"))).select("trace", "group", *VOXEL, "density")


def _spheres(p: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and squared radius of the sphere through each cell's points."""
    first = p[cells[:, 0]]
    edges = p[cells[:, 1:]] - first[:, None]
    centre = np.linalg.solve(edges, (edges**2).sum(-1)[..., None] / 2)[..., 0]
    return centre + first, (centre**2).sum(-1)


def delaunay(points: np.ndarray) -> set[tuple[int, int]]:
    """Pairs i < j of points that share a cell of the Delaunay mesh, points being put in one at a time: the cells whose sphere holds the new point give
    way to cells of their outer faces and the point.  Cells outside the hull have a face and a plane instead.  Points on one sphere or plane
    are told apart by a fixed shift of each by at most 1e-5 of the extent.  With too few points for a cell all are neighbours."""
    n, dim = points.shape
    if n < dim + 2:
        return set(itertools.combinations(range(n), 2))
    extent = float(np.ptp(points, axis=0).max()) or 1.0
    p = points + np.random.default_rng(7).uniform(-1e-5, 1e-5, points.shape) * extent
    p = (p - p.mean(0)) / extent
    cells = np.arange(dim + 1)[None]
    inside = p[: dim + 1].mean(0)
    faces = np.array(list(itertools.combinations(range(dim + 1), dim)))  # of the hull

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = p[f[:, 1:]] - p[f[:, :1]]
        normal = np.stack([(-1) ** k * np.linalg.det(np.delete(edges, k, 2)) for k in range(dim)], 1) if dim > 1 else np.ones((len(f), 1))
        off = (normal * p[f[:, 0]]).sum(1)
        turn = np.where(normal @ inside > off, -1.0, 1.0)
        return normal * turn[:, None], off * turn

    (centre, radius), (normal, off) = _spheres(p, cells), planes(faces)
    for new in range(dim + 1, n):
        held = ((centre - p[new]) ** 2).sum(1) < radius
        beyond = normal @ p[new] > off
        sides = np.concatenate([np.delete(cells[held], k, 1) for k in range(dim + 1)] + [faces[beyond]])
        ridges = np.concatenate([np.delete(faces[beyond], k, 1) for k in range(dim)]) if beyond.any() else np.zeros((0, dim - 1), int)
        outer, times = np.unique(np.sort(sides, 1), axis=0, return_counts=True)
        outer = outer[times == 1]
        edge, times = np.unique(np.sort(ridges, 1), axis=0, return_counts=True)
        edge = edge[times == 1]
        more = np.column_stack([outer, np.full(len(outer), new)])
        rim = np.column_stack([edge, np.full(len(edge), new)])
        cells, faces = np.concatenate([cells[~held], more]), np.concatenate([faces[~beyond], rim])
        c, r = _spheres(p, more) if len(more) else (np.zeros((0, dim)), np.zeros(0))
        q, o = planes(rim) if len(rim) else (np.zeros((0, dim)), np.zeros(0))
        centre, radius = np.concatenate([centre[~held], c]), np.concatenate([radius[~held], r])
        normal, off = np.concatenate([normal[~beyond], q]), np.concatenate([off[~beyond], o])
    return {tuple(sorted(pair)) for cell in cells.tolist() for pair in itertools.combinations(cell, 2)}


def mesh_neighbours(points: DataFrame, by: str, id_: str, axes: list[str]) -> DataFrame:
    """by, id and neighbour (both ways) of the points of each group that share a cell of its Delaunay mesh.  A mesh needs its points together: a
    grouped-map function over a group, the spots of one image."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        pairs = np.array(sorted(delaunay(pdf[axes].to_numpy(float))), int).reshape(-1, 2)
        names = pdf[id_].to_numpy()
        both = np.concatenate([pairs, pairs[:, ::-1]])
        return pd.DataFrame({by: pdf[by].iloc[0], id_: names[both[:, 0]], "neighbour": names[both[:, 1]]})

    kinds = dict(points.dtypes)
    return points.dropna(subset=axes).select(by, id_, *axes).groupBy(by).applyInPandas(work, f"{by} {kinds[by]}, {id_} {kinds[id_]}, neighbour {kinds[id_]}")


def steady_in_mesh(moves: DataFrame, by: str, id_: str, axes: list[str], shift: list[str], sigmas: float = 1.5) -> DataFrame:
    """Moves that agree with those beside them in the mesh of their places: by distance from the mean move of the neighbours, weighted by inverse
    distance, below the group's mean plus ``sigmas`` population deviations."""
    beside = mesh_neighbours(moves, by, id_, axes)
    here = moves.select(by, id_, *[F.col(c).alias(f"_a_{c}") for c in axes])
    there = moves.select(by, F.col(id_).alias("neighbour"), *[F.col(c).alias(f"_b_{c}") for c in axes], *[F.col(c).alias(f"_s_{c}") for c in shift])
    both = beside.join(here, [by, id_]).join(there, [by, "neighbour"])
    weight = 1 / F.greatest(distance([F.col(f"_a_{c}") for c in axes], [F.col(f"_b_{c}") for c in axes]), F.lit(1e-9))
    mean = both.groupBy(by, id_).agg(*[(F.sum(F.col(f"_s_{c}") * weight) / F.sum(weight)).alias(f"_m_{c}") for c in shift])
    off = moves.join(mean, [by, id_]).withColumn("off", distance([F.col(c) for c in shift], [F.col(f"_m_{c}") for c in shift]))
    w = W.partitionBy(by)
    return off.withColumn("_l", F.avg("off").over(w) + sigmas * F.stddev_pop("off").over(w)).filter("off < _l").drop("_l", *[f"_m_{c}" for c in shift])
