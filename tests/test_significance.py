"""Ranks, tests and controls against plain versions and published values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import significance as S

POINT = "trace long, locus long, z double, x double, y double, cls string, chr long, copy long"


def sample(spark, seed=1, n=600, ties=True):
    rng = random.Random(seed)
    value = lambda g: rng.choice([None, float(rng.randint(0, 9)), rng.gauss(g, 3)]) if ties else rng.gauss(g, 3)
    rows = [(rng.choice([0, 0, 0, 1, None]), value(0), rng.random() < 0.4, rng.gauss(0, 1)) for _ in range(n)] + [(7, 1.0, True, 0.0), (8, None, True, 0.0)]
    return rows, spark.createDataFrame(rows, "g long, v double, a boolean, w double").repartition(5)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def mean_ranks(values):
    order = sorted(values)
    return {v: np.mean([i + 1 for i, x in enumerate(order) if x == v]) for v in set(values)}


def test_running_counts_do_not_depend_on_ranges(spark):
    rows, df = sample(spark)
    for ranges in (1, 3, 64):
        run = S.running(df, ["g"], "v", {"n": F.count("*"), "a": F.count_if(F.col("a"))}, ranges)
        for r in run.collect():
            mine = by_group(rows)[r.g]
            upto = [x for x in mine if x[1] is None or (r.v is not None and x[1] <= r.v)]
            assert (r.run_n, r.run_a, r.all_n, r.all_a) == (len(upto), sum(x[2] for x in upto), len(mine), sum(x[2] for x in mine))


def test_quantiles_and_ranks(spark):
    rows, df = sample(spark, 2)
    shares = {"lo": 0.05, "mid": 0.5, "q": 0.77, "top": 1.0}
    got = {r.g: r for r in S.group_quantiles(df, ["g"], "v", shares).collect()}
    ranks = {(r.g, r.v): r["rank"] for r in S.mid_ranks(df, ["g"], "v").collect()}
    for g, mine in by_group(rows).items():
        known = [x[1] for x in mine if x[1] is not None]
        for name, s in shares.items():
            assert got[g][name] == (pytest.approx(np.quantile(known, s)) if known else None)
        assert {k[1]: v for k, v in ranks.items() if k[0] == g} == pytest.approx(mean_ranks(known))


def test_rank_sum(spark):
    for seed, n in ((3, 500), (4, 24)):
        rows, df = sample(spark, seed, n, n > 100)
        got = {r.g: r for r in S.rank_sum(df, ["g"], "v", F.col("a")).collect()}
        for g, mine in by_group(rows).items():
            one, two = ([x[1] for x in mine if x[1] is not None and x[2] == k] for k in (True, False))
            if not one + two:
                assert g not in got
                continue
            u = sum((x > y) + (x == y) / 2 for x in one for y in two)
            assert (got[g].n1, got[g].n2, got[g].u) == (len(one), len(two), u)
            both = one + two
            tied = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
            if one and two and len(both) > 2:
                z = (u - len(one) * len(two) / 2) / math.sqrt(len(one) * len(two) / 12 * (len(both) + 1 - tied / len(both) / (len(both) - 1)))
                assert got[g].z == pytest.approx(z) and got[g].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
            if not tied and 0 < len(one) * len(two) <= 30:
                us = [sum(x > y for x in c for y in range(len(both)) if y not in c) for c in itertools.combinations(range(len(both)), len(one))]
                assert got[g].p_exact == pytest.approx(min(1, 2 * sum(v <= min(u, len(one) * len(two) - u) for v in us) / len(us)))


def test_signed_rank(spark):
    for seed, n, ties in ((5, 300, True), (6, 20, False)):
        rows, df = sample(spark, seed, n, ties)
        df = df.withColumn("w", F.round("w")) if ties else df
        rows = [(*r[:3], float(math.copysign(math.floor(abs(r[3]) + 0.5), r[3])) if ties else r[3]) for r in rows]
        got = {r.g: r for r in S.signed_rank(df, ["g"], "v", "w").collect()}
        for g, mine in by_group(rows).items():
            d = [x[1] - x[3] for x in mine if x[1] is not None and x[1] != x[3]]
            if not d:
                continue
            rank = mean_ranks([abs(x) for x in d])
            plus, minus = sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)
            k, size = len(d), [abs(x) for x in d]
            tied = sum(size.count(v) ** 3 - size.count(v) for v in set(size))
            z = (min(plus, minus) - k * (k + 1) / 4) / math.sqrt((k * (k + 1) * (2 * k + 1) - tied / 2) / 24)
            assert (got[g].n, got[g].statistic) == (k, min(plus, minus)) and got[g].z == pytest.approx(z)
            if not tied and k <= 12:
                sums = [sum(i + 1 for i in range(k) if s >> i & 1) for s in range(2**k)]
                assert got[g].p_exact == pytest.approx(min(1, 2 * sum(x <= min(plus, minus) for x in sums) / 2**k))


def test_published_values(spark):
    """Critical values as tables print them."""
    one = lambda **c: spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in c.items()])
    of = lambda df, c: df.select(c.alias("p")).first().p
    assert of(one(n=10, s=8), S.exact_signed_rank("n", "s")) == pytest.approx(0.0488, abs=5e-5)
    assert of(one(n=20, s=52), S.exact_signed_rank("n", "s")) == pytest.approx(0.0484, abs=5e-5)
    assert of(one(a=5, b=5, u=2), S.exact_rank_sum("a", "b", "u")) == pytest.approx(0.0317, abs=5e-5)
    assert of(one(a=8, b=10, u=17), S.exact_rank_sum("a", "b", "u")) == pytest.approx(0.0434, abs=5e-5)
    assert of(one(a=5, b=5, d=0.8), S.exact_ks("a", "b", "d")) == pytest.approx(0.0794, abs=5e-5)
    assert of(one(a=5, b=5, d=1), S.exact_ks("a", "b", "d")) == pytest.approx(0.0079, abs=5e-5)
    assert of(one(z=1.959964), S.normal_tails("z")) == pytest.approx(0.05, abs=1e-6)
    for t, free, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (2.750, 30, 0.01), (0.0, 4, 1.0)):
        assert of(one(t=t, f=free), S.t_tails("t", "f")) == pytest.approx(p, abs=2e-5)
    for x, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01), (0.5, 0.9639), (0.2, 1.0), (0.0, 1.0), (1.0, 0.27)):
        assert of(one(x=x), S.kolmogorov_tail(F.col("x"))) == pytest.approx(p, abs=1e-4)


def test_ks_test(spark):
    rows, df = sample(spark, 8, 60)
    got = {r.g: r for r in S.ks_test(df, ["g"], "v", F.col("a")).collect()}
    for g, mine in by_group(rows).items():
        one, two = ([x[1] for x in mine if x[1] is not None and x[2] == k] for k in (True, False))
        if not one or not two:
            continue
        d = max(abs(sum(x <= t for x in one) / len(one) - sum(x <= t for x in two) / len(two)) for t in one + two)
        assert (got[g].n1, got[g].n2) == (len(one), len(two)) and got[g].ks == pytest.approx(d)
    small, total = [], 0
    for c in itertools.combinations(range(9), 4):
        rest = [x for x in range(9) if x not in c]
        small.append(max(abs(sum(x <= t for x in c) / 4 - sum(x <= t for x in rest) / 5) for t in range(9)))
    for d in sorted(set(small)):
        total += 1
        assert 1 - S.ks_within(4, 5, d) == pytest.approx(sum(x >= d - 1e-12 for x in small) / len(small))
    assert total > 5


def cloud(seed, n, groups="AB"):
    rng = np.random.default_rng(seed)
    return [(int(seed), i, *map(float, rng.normal(0, 1, 3)), groups[int(rng.integers(len(groups)))], i // 4, i % 2) if rng.random() > 0.1 else (int(seed), i, None, None, None, "A", 0, 0) for i in range(n)]


@pytest.mark.parametrize("apart", [None, ["chr", "copy"]])
def test_density_controls(spark, apart):
    rows = cloud(1, 40, "ABC") + cloud(2, 12) + [(3, 0, None, None, None, "A", 0, 0), (4, 0, 0.0, 0.0, 0.0, "A", 0, 0)]
    results = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, POINT).repartition(parts, "locus")
        results.append({(r.trace, r.locus, r.group): (r.density, r.mean, r.sd, r.above) for r in S.density_controls(df, "cls", 0.8, 7, apart=apart).collect()})
    assert results[0].keys() == results[1].keys() and all(results[0][k] == pytest.approx(results[1][k]) for k in results[0])
    for t in (1, 2):
        mine = [r for r in rows if r[0] == t and r[2] is not None]
        loci, labels = np.array([r[1] for r in mine]), np.array([r[5] for r in mine])
        draws = [S.shuffled(t, loci, labels, k) for k in range(7)]
        assert all(sorted(d) == sorted(labels) for d in draws) and len({tuple(d) for d in draws}) == 7
        for i, r in enumerate(mine):
            for g in set(labels):
                kernel = [math.exp(-math.dist(r[2:5], q[2:5]) ** 2 / 1.28) if (r[6:8] != q[6:8] if apart else j != i) else 0.0 for j, q in enumerate(mine)]
                null = [sum(k for k, x in zip(kernel, d, strict=True) if x == g) for d in draws]
                now = sum(k for k, x in zip(kernel, labels, strict=True) if x == g)
                assert results[0][t, r[1], g] == pytest.approx((now, np.mean(null), np.std(null), np.mean([x >= now - 1e-12 for x in null])))


def test_mixing_controls_near_all_permutations(spark):
    """A tiny trace: the moments of many shuffles come near those of all ways to deal the labels."""
    rows = [(5, i, *p, c, 0, 0) for i, (p, c) in enumerate(zip([(0.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.0, 0.2, 0.0), (2.0, 2.0, 2.0), (2.1, 2.0, 2.0), (2.0, 1.8, 2.0)], "AAABBB", strict=True))]
    got = S.mixing_controls(spark.createDataFrame(rows + [(6, 0, 0.0, 0.0, 0.0, "A", 0, 0)], POINT), "cls", 0.5, 4000).collect()
    assert [r.trace for r in got] == [5]

    def score(labels):
        out = []
        for i, r in enumerate(rows):
            k = [math.exp(-math.dist(r[2:5], q[2:5]) ** 2 / 0.5) if j != i else 0 for j, q in enumerate(rows)]
            out.append(sum(x for x, c in zip(k, labels, strict=True) if c == labels[i]) / sum(k))
        return np.mean(out)

    ways = [score(["A" if i in c else "B" for i in range(6)]) for c in itertools.combinations(range(6), 3)]
    assert got[0].score == pytest.approx(score("AAABBB")) and got[0].mean == pytest.approx(np.mean(ways), abs=0.02) and got[0].sd == pytest.approx(np.std(ways), abs=0.02)
    assert got[0].p == pytest.approx(2 / 20, abs=0.02) and got[0].z == pytest.approx((got[0].score - got[0].mean) / got[0].sd)
