"""Picks over all traces against plain loops, joint chains against all choices."""

import itertools
import math

import numpy as np
import pytest

from quillspan.operators import picking

CANDIDATE = "trace long, locus long, candidate long, z double, x double, y double, brightness double"


def traces(seed, n=5, loci=14):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        centre = rng.normal(0, 5, 3)
        for i in range(loci):
            for c in range(int(rng.integers(0, 5))):
                p = centre + rng.normal(0, 1 if c == 1 else 4, 3)
                rows.append((t, i, c, *(float(round(v, 3)) for v in p), float(round(rng.uniform(0.5, 2) + (c == 1), 2))))
    rows += [(0, 2, 90, None, 0.0, 0.0, 9.0), (0, 2, 91, 0.0, 0.0, 0.0, None), (77, 3, 0, 1.0, 1.0, 1.0, 1.0)]
    return rows


def plain_population(rows, rounds, least, by_region, reach):
    rows = [r for r in rows if None not in r]
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    picks = {k: min(v, key=lambda r: (-r[6], r[2])) for k, v in by.items()}
    moved = []
    while not (moved and moved[-1] < least) and not (len(moved) > 5 and np.mean(moved[-5:]) <= 2 * least) and len(moved) < rounds:
        def features(r):
            t = [p for k, p in picks.items() if k[0] == r[0]]  # noqa: B023
            near = [p[3:6] for p in t if p[1] != r[1] and abs(p[1] - r[1]) <= reach]
            lc = math.dist(r[3:6], np.mean(near, 0)) if near else None
            return r[6], math.dist(r[3:6], np.mean([p[3:6] for p in t], 0)), lc

        pool = {}
        for p in picks.values():
            for name, v in zip("bcl", features(p), strict=True):
                if v is not None:
                    pool.setdefault((name, p[1] if by_region else 0), []).append(v)
        new = {}
        for k, cs in by.items():
            best = None
            for r in sorted(cs, key=lambda r: r[2]):
                f = dict(zip("bcl", features(r), strict=True))
                share = {n: np.mean([x <= v + 1e-12 for x in pool[n, r[1] if by_region else 0]]) for n, v in f.items() if v is not None}
                s = share["b"] * (1 - share["c"]) * (1 - share.get("l", 0))
                if best is None or s > best[0] + 1e-12:
                    best = (s, r)
            new[k] = best[1]
        moved.append(np.mean([new[k][2] != picks[k][2] for k in picks]))
        picks = new
    return {k: p[2] for k, p in picks.items()}, moved


@pytest.mark.parametrize(("by_region", "rounds"), [(False, 8), (True, 2)])
def test_population_picks(spark, by_region, rounds):
    rows = traces(3)
    got, moved, why = picking.pick_in_population(spark.createDataFrame(rows, CANDIDATE).repartition(3), rounds, 0.01, by_region, 3)
    want, changes = plain_population(rows, rounds, 0.01, by_region, 3)
    assert moved == pytest.approx(changes) and changes[0] > 0
    assert {(r.trace, r.locus): r.candidate for r in got.collect()} == want
    assert why == ("settled" if changes[-1] < 0.01 else "rounds" if len(changes) == rounds else "oscillates")


def test_rules_that_end_rounds():
    assert picking.ended([], 3, 0.01) is None and picking.ended([], 0, 0.01) == "rounds"
    assert picking.ended([0.5, 0.005], 9, 0.01) == "settled"
    assert picking.ended([0.5, 0.02, 0.02, 0.02, 0.02], 9, 0.01) is None
    assert picking.ended([0.5, 0.02, 0.02, 0.02, 0.02, 0.02], 9, 0.01) == "oscillates"
    assert picking.ended([0.5, 0.4, 0.3], 3, 0.01) == "rounds"


def total(places, scores, gaps, weights, missing, path):
    out = 0.0
    for k, pair in enumerate(path):
        for h, c in enumerate(pair):
            out += scores[k][c, h] if c >= 0 else missing
            if k and c >= 0 and path[k - 1][h] >= 0:
                out -= weights[h] * math.dist(places[k][c], places[k - 1][path[k - 1][h]]) / max(gaps[k - 1], 1)
    return out


@pytest.mark.parametrize("share", [False, True])
def test_joint_chain_is_the_best_of_all(share):
    for seed in range(25):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(0, 4, 4)
        places, scores = [rng.normal(0, 1, (n, 3)) for n in sizes], [rng.normal(0, 1, (n, 2)) for n in sizes]
        gaps, weights, missing = rng.integers(1, 4, 3).tolist(), rng.uniform(0, 2, 2), float(rng.choice([-1000.0, -0.5]))
        best, path = picking.joint_chain(places, scores, gaps, weights, missing, share)
        options = [[(a, b) for a in range(-1, n) for b in range(-1, n) if share or a != b or a < 0] for n in sizes]
        assert best == pytest.approx(max(total(places, scores, gaps, weights, missing, p) for p in itertools.product(*options)))
        assert total(places, scores, gaps, weights, missing, path) == pytest.approx(best)
        assert share or all(a != b or a < 0 for a, b in path)


def test_homologs(spark):
    """Two far homologs with noise between: each gets its own spots; no spot is given twice."""
    rng = np.random.default_rng(4)
    rows, homes, true = [], [], {}
    for cell in range(4):
        home = [np.array([0.0, 0, 0]), np.array([6.0, 0, 0])]
        homes += [(cell, h, *map(float, p)) for h, p in enumerate(home)]
        at = [h.copy() for h in home]
        for i in range(25):
            spots = []
            for h in range(2):
                at[h] = home[h] + 0.6 * (at[h] - home[h]) + rng.normal(0, 0.4, 3)
                if rng.random() > 0.1:
                    spots.append((h, at[h], 5.0))
            spots += [(None, rng.uniform(-4, 10, 3), 1.0) for _ in range(int(rng.integers(0, 3)))]
            for c, k in enumerate(rng.permutation(len(spots))):
                h, p, b = spots[k]
                rows.append((cell, i, c, *map(float, p), b))
                if h is not None:
                    true[cell, h, i] = c
    rows += [(0, 30, 0, None, 1.0, 1.0, 1.0), (9, 0, 0, 1.0, 1.0, 1.0, 1.0)]
    homes += [(8, 0, 0.0, 0.0, 0.0), (8, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cell long, locus long, candidate long, z double, x double, y double, brightness double")
    centres = spark.createDataFrame(homes, "cell long, homolog long, z double, x double, y double")
    got = picking.pick_homologs(df, centres).collect()
    picked = {(r.cell, r.homolog, r.locus): r.candidate for r in got}
    assert {r.cell for r in got} == {0, 1, 2, 3} and {r.why for r in got} <= {"settled", "oscillates", "rounds"}
    assert len({(r.cell, r.locus, r.candidate) for r in got}) == len(got)
    assert np.mean([picked.get(k) == c for k, c in true.items()]) > 0.95
    assert {(r.rounds, r.why) for r in picking.pick_homologs(df, centres, rounds=1).collect()} <= {(1, "rounds"), (1, "settled")}
