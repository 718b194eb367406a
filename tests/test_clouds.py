"""Clouds, maxima and meshes against dense grids and exhaustive checks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import clouds

POINT = "trace long, locus long, z double, x double, y double, cls string, bright double"


def spots(seed, n, span):
    rng = np.random.default_rng(seed)
    return [(t, i, *(map(float, rng.uniform(-span, span, 3))), "AB"[i % 2], float(rng.uniform(0.5, 2))) if rng.random() > 0.1 else (t, i, None, 1.0, 1.0, "A", 1.0) for t in range(2) for i in range(n)]


def dense(rows, voxel, sigma, reach, weight):
    out = {}
    for t, _, *p, g, b in rows:
        if None in p:
            continue
        q = [v / voxel for v in p]
        own = [int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in q]
        for step in itertools.product(range(-reach, reach + 1), repeat=3):
            v = tuple(o + s for o, s in zip(own, step, strict=True))
            out[(t, g, *v)] = out.get((t, g, *v), 0.0) + (b if weight else 1.0) * math.exp(-sum((a - c) ** 2 for a, c in zip(v, q, strict=True)) / (2 * sigma * sigma))
    return out


@pytest.mark.parametrize("normal", [None, "count", "pdf"])
def test_clouds(spark, normal):
    rows = spots(1, 30, 3.0)
    got = clouds.clouds(spark.createDataFrame(rows, POINT).repartition(4), "cls", 0.5, 1.2, 3, F.col("bright"), normal).collect()
    want = dense(rows, 0.5, 1.2, 3, True)
    for t in range(2):
        for g in "AB":
            by = {None: 1, "count": sum(r[0] == t and r[5] == g and r[2] is not None for r in rows), "pdf": sum(v for k, v in want.items() if k[:2] == (t, g))}[normal]
            have = {(r.vz, r.vx, r.vy): r.density for r in got if (r.trace, r.group) == (t, g)}
            assert have == pytest.approx({k[2:]: v / by for k, v in want.items() if k[:2] == (t, g)})


@pytest.mark.parametrize(("window", "edge"), [(10, 16), (5, 4), (4, 7)])
def test_local_maxima(spark, window, edge):
    rows = spots(2, 60, 12.0)
    cloud = clouds.clouds(spark.createDataFrame(rows, POINT), "cls", 1.0, 1.6, 5)
    cells = {(r.trace, r.group, r.vz, r.vx, r.vy): r.density for r in cloud.collect()}
    found = {(r.trace, r.group, r.vz, r.vx, r.vy): r for r in clouds.window_maxima(cloud, window, edge).collect()}
    low, high, want, total = -window // 2 if window % 2 == 0 else -(window // 2), (window - 1) // 2, {}, 0
    for t, g in itertools.product(range(2), "AB"):
        mine = {k[2:]: v for k, v in cells.items() if k[:2] == (t, g)}
        at = np.array(list(mine))
        origin = at.min(0) - 12
        grid = np.zeros(at.max(0) - origin + 13)
        for k, v in mine.items():
            grid[tuple(np.array(k) - origin)] = v
        first, tops = np.gradient(grid), []
        second = [[np.gradient(first[k])[m] for m in range(3)] for k in range(3)]
        for k, v in mine.items():
            p = np.array(k) - origin
            if v == grid[tuple(slice(a + low, a + high + 1) for a in p)].max():
                h = np.array([[second[a][b][tuple(p)] for b in range(3)] for a in range(3)])
                tops.append((k, v, h))
        assert {k[2:] for k in found if k[:2] == (t, g)} == {k for k, *_ in tops}
        for k, _, h in tops:
            r = found[(t, g, *k)]
            assert np.array([[r.hzz, r.hzx, r.hzy], [r.hzx, r.hxx, r.hxy], [r.hzy, r.hxy, r.hyy]]) == pytest.approx(h, abs=1e-12)
        most = max(v for _, v, _ in tops)
        good = {(t, g, *k) for k, v, h in tops if (np.linalg.eigvalsh((h + h.T) / 2) < 0).all() and v > 0.5 * most}
        want |= dict.fromkeys(good)
        total += len(tops)
    if (window, edge) == (10, 16):
        assert {(r.trace, r.group, r.vz, r.vx, r.vy) for r in clouds.local_maxima(cloud, window, 0.5).collect()} == want.keys()
        assert 4 < len(want) < total


@pytest.mark.parametrize("dim", [2, 3])
def test_delaunay_by_empty_spheres(dim):
    """Two points are neighbours if and only if some cell with an empty sphere has both."""
    for seed, n in ((1, 5), (2, 9), (3, 18), (4, 24)):
        p = np.random.default_rng(seed).normal(0, 3, (n, dim))
        want = set()
        for cell in itertools.combinations(range(n), dim + 1):
            centre, radius = clouds._spheres(p, np.array([cell]))
            if not any(((p[k] - centre[0]) ** 2).sum() < radius[0] - 1e-9 for k in range(n) if k not in cell):
                want |= set(itertools.combinations(cell, 2))
        assert clouds.delaunay(p) == want
    assert clouds.delaunay(p[: dim + 1]) == set(itertools.combinations(range(dim + 1), 2)) and clouds.delaunay(p[:1]) == set()


def test_meshes_of_degenerate_points(spark):
    grid = np.array(list(itertools.product(range(4), repeat=3)), float)
    pairs = clouds.delaunay(grid)
    assert all((i, j) in pairs for i, j in itertools.combinations(range(64), 2) if np.abs(grid[i] - grid[j]).sum() == 1)
    inner = {k for k, q in enumerate(grid) if ((q > 0) & (q < 3)).all()}
    assert all(np.abs(grid[i] - grid[j]).max() <= 1 for i, j in pairs if i in inner or j in inner)
    assert len(clouds.delaunay(np.zeros((12, 3)))) >= 11 and len(clouds.delaunay(np.column_stack([np.arange(10.0), np.zeros(10), np.zeros(10)]))) >= 9


def test_steady_in_mesh(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, *map(float, rng.uniform(0, 10, 3)), *map(float, rng.normal(1, 0.1, 3))) for g in range(3) for i in range(25 if g else 3)]
    rows[10] = (*rows[10][:5], 9.0, 9.0, 9.0)
    df = spark.createDataFrame(rows, "g long, id long, z double, x double, y double, dz double, dx double, dy double")
    got = {(r.g, r.id) for r in clouds.steady_in_mesh(df, "g", "id", ["z", "x", "y"], ["dz", "dx", "dy"], 1.5).collect()}
    want = set()
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        near = clouds.delaunay(np.array([r[2:5] for r in mine]))
        off = []
        for i, r in enumerate(mine):
            of = [mine[b if a == i else a] for a, b in near if i in (a, b)]
            w = np.array([1 / math.dist(r[2:5], q[2:5]) for q in of])
            off.append(math.dist(r[5:], (np.array([q[5:] for q in of]) * w[:, None]).sum(0) / w.sum()))
        want |= {(g, r[1]) for r, o in zip(mine, off, strict=True) if o < np.mean(off) + 1.5 * np.std(off)}
    assert got == want and (rows[10][0], rows[10][1]) not in got and len(got) > 40
