"""Operators that SQL does not express, and hand cases of the others, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import codes, decode, filters, interaction, peaks, scores, segments, spots

POINT = "trace long, locus long, z double, x double, y double"


def test_sparse_centres(spark):
    rng = random.Random(2)
    rows = [(g, i, *(rng.randint(0, 8) / 2 for _ in range(3))) for g in (0, 1) for i in range(80)] + [(0, 99, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, POINT)
    for norm, far in (("box", lambda p, q: max(abs(a - b) for a, b in zip(p, q, strict=True))), ("euclid", math.dist)):
        want = set()
        for g in (0, 1):
            kept = []
            for h, i, *p in rows:
                if h == g and p[0] is not None and all(far(p, q) > 1.0 for _, q in kept):
                    kept.append((i, p))
            want |= {(g, i) for i, _ in kept}
        assert {tuple(r) for r in filters.sparse_centres(d, "trace", "locus", ["z", "x", "y"], 1.0, norm).collect()} == want


def plain_peaks(v, distance, prominence, width):
    found = []
    for i in range(1, len(v) - 1):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            found.append((i + j) // 2)
    stay = list(found)
    for p in sorted(found, key=lambda p: (-v[p], -p)):
        if p in stay:
            stay = [q for q in stay if q == p or abs(q - p) >= distance]
    out = []
    for p in stay:
        left = max([k + 1 for k in range(p) if v[k] > v[p]], default=0)
        right = min([k - 1 for k in range(p + 1, len(v)) if v[k] > v[p]], default=len(v) - 1)
        height = v[p] - max(min(v[left : p + 1]), min(v[p : right + 1]))
        half = v[p] - height / 2
        a = max((k for k in range(left, p + 1) if v[k] <= half), default=left)
        b = min((k for k in range(p, right + 1) if v[k] <= half), default=right)
        low = a + (half - v[a]) / (v[a + 1] - v[a]) if v[a] < half else a
        high = b - (half - v[b]) / (v[b - 1] - v[b]) if v[b] < half else b
        if height >= prominence and high - low >= width:
            out.append((p, height, high - low))
    return out


def test_find_peaks(spark):
    rng = random.Random(4)
    rows, want = [], []
    options = (3, 1.5, 1.0)
    for t in range(20):
        v = [rng.choice([rng.randint(0, 6), rng.random() * 6]) for _ in range(rng.randint(1, 60))]
        rows += [(t, i, float(x)) for i, x in enumerate(v)]
        want += [(t, *p) for p in plain_peaks(v, *options)]
    got = peaks.find_peaks(spark.createDataFrame(rows, "trace long, locus long, v double"), "v", *options).collect()
    assert len(want) > 20 and np.array(sorted(map(tuple, got))) == pytest.approx(np.array(sorted(want)))
    at, height, _ = peaks.peak_places(np.array([0, 1, 0, 5, 5, 5, 0, 2.0]))
    assert at.tolist() == [1, 4] and height.tolist() == [1, 5]


def test_small_runs(spark):
    rng = random.Random(5)

    def plain(v, least):
        v = list(v)
        while True:
            runs = [list(g) for _, g in itertools.groupby(range(len(v)), lambda i: v[i])]
            if len(runs) < 2 or min(map(len, runs)) >= least:
                return v
            for i in min(runs, key=len):
                v[i] = 1 - v[i]

    lists = {t: [rng.randint(0, 1) for _ in range(40)] for t in range(10)} | {20: [1, 1, 0, 1, 1, 1]}
    rows = [(t, i, x) for t, v in lists.items() for i, x in enumerate(v)]
    got = peaks.without_small_runs(spark.createDataFrame(rows, "trace long, locus long, l int"), "l", 3).orderBy("trace", "locus").collect()
    assert [tuple(r) for r in got] == [(t, i, x) for t, v in lists.items() for i, x in enumerate(plain(v, 3))]
    assert {r.l for r in got if r.trace == 20} == {1}


def test_order_dependent_choices(spark):
    near = spark.createDataFrame([(1, 0, 0, 0.1), (1, 1, 0, 0.2), (1, 1, 1, 0.3), (1, 2, 1, 0.1), (1, 2, 2, 0.1), (1, 3, 2, 0.1)], "g long, a long, b long, dist double")
    assert sorted((r.a, r.b) for r in decode.aligned_in_order(near, "g").collect()) == [(0, 0), (1, 1), (2, 2)]
    rng = random.Random(6)
    rows = [(g, s, s + rng.randint(2, 30)) for g in (0, 1) for s in rng.sample(range(400), 40)]

    def plain(all_):
        all_ = sorted(all_)
        i = 0
        while i < len(all_) - 1:
            if all_[i + 1][0] < all_[i][1]:
                del all_[i]
                i = 0
            else:
                i += 1
        return all_

    got = decode.without_overlaps(spark.createDataFrame(rows, "g long, s long, e long"), "g", "s", "e").collect()
    assert sorted(map(tuple, got)) == sorted((g, *x) for g in (0, 1) for x in plain([(s, e) for h, s, e in rows if h == g]))


def test_rigid(spark):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.linalg.det(q)
    p = rng.normal(size=(50, 3))
    t = np.array([1.0, -2.0, 3.0])
    rows = [(1, *map(float, a), *map(float, q @ a + t)) for a in p] + [(1, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    r = spots.rigid(spark.createDataFrame(rows, "trace long, z double, x double, y double, z2 double, x2 double, y2 double"), "trace").first()
    assert r.n == 50 and r.error < 1e-5
    assert np.array(r.rotation).reshape(3, 3) == pytest.approx(q, abs=1e-8) and r.translation == pytest.approx(list(t), abs=1e-8)


def test_domains_by_sliding_and_correlation(spark):
    rng = np.random.default_rng(8)
    centre = [(0, 0, 0), (9, 0, 0), (0, 9, 0)]
    rows = [(1, i, *(float(x) for x in centre[i // 10] + rng.normal(0, 1, 3))) for i in range(30)]
    p = spark.createDataFrame(rows, POINT)
    scored = spark.createDataFrame([(1, i, 5.0 if i in (10, 20) else 1.0 if i == 5 else 0.0) for i in range(30)], "trace long, c long, score double")
    plain = interaction.sliding_domains(scored, p, 3, 0.5, merge=False).orderBy("segment").collect()
    assert [(r["first"], r["last"]) for r in plain] == [(0, 4), (5, 9), (10, 19), (20, 29)]
    merged = interaction.sliding_domains(scored, p, 3, 0.5).orderBy("segment").collect()
    assert [(r["first"], r["last"]) for r in merged] == [(0, 9), (10, 19), (20, 29)]
    cuts = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 10, 29)], "trace long, segment long, first long, last long")
    xyz = np.array([r[2:] for r in rows])
    corr = np.corrcoef(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)))
    want = np.linalg.norm(corr[:10].mean(0) - corr[10:].mean(0)) / 30
    assert [tuple(r) for r in interaction.correlation_distances(p, cuts).collect()] == [(1, 0, 1, pytest.approx(want))]
    held = segments.segments_of(spark.createDataFrame([(1, 9), (1, 10), (1, 40), (2, 1)], "trace long, locus long"), cuts).collect()
    assert sorted((r.locus, r.segment) for r in held) == [(9, 0), (10, 1)]


def test_probe_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    # by hand: two steps CA (-8.5, -22.7) and AG = CT (-7.8, -21.0), one A or T end of two: none here
    h, s = 0.2 - 8.5 - 7.8, -5.7 - 22.7 - 21.0 + 0.368 * 2 * math.log(0.05)
    assert one(codes.melting(F.lit("CAG"))) == pytest.approx(1000 * h / (s + 1.987 * math.log(12.5e-9)) - 273.15)
    assert one(codes.melting(F.lit("GATC"))) > one(codes.melting(F.lit("AATT")))
    good = "ACGTCATGATCAGCTTAGAC"
    assert one(codes.good_readout(F.lit(good), c=(0.1, 0.4)))
    for bad in ("ACGTCATGAAAAGCTTAGAC", "ATATCATGATTAGTAATGAT", "CCGCCCTGATCAGTTATGAT", "ACGTCAACGTCATTTAGACC", ""):
        assert not one(codes.good_readout(F.lit(bad), c=(0.1, 0.4)))
    assert one(codes.primers_fit(F.lit("ACGTTTGG"), "AC", "TTCC", 2)) and not one(codes.primers_fit(F.lit("ACGTTTGG"), "AC", "TTCA", 2))
    assert one(codes.readout_tags(F.lit("H20R35,B"))) == ["R35", "B"]


def test_scores_by_hand(spark):
    row = spark.createDataFrame([(10.0, 5.0), (None, None), (40.0, -1.0)], "d double, v double")
    got = row.select(scores.linear_distance_score(F.col("d"), F.lit(10.0), 2.0, 20.0).alias("d"), scores.linear_intensity_score(F.col("v"), F.lit(5.0)).alias("v")).collect()
    assert [r.d for r in got] == [-2, -1000, -12] and [r.v for r in got] == [pytest.approx(math.log(0.5)), 0, -1000]
    stats = spark.createDataFrame([(1, 0.0, 1.0)], "g long, mean double, deviation double")
    values = spark.createDataFrame([(1, 5.0), (1, 3.0), (1, 1.0)], "g long, v double")
    assert sorted((r.v, r.flag) for r in scores.p_value_flags(values, stats, "g", "v").collect()) == [(1, -1), (3, 0), (5, 1)]
    rows = spark.createDataFrame([("a", float(i)) for i in range(40)] + [("b", 3.0 * i + 7) for i in range(40)] + [("b", None)], "g string, v double")
    flat = scores.flattened(rows, "g", "v", rows.filter("g = 'a'")).collect()
    assert all(r.flat == pytest.approx(r.v if r.g == "a" else (r.v - 7) / 3) for r in flat if r.v is not None)


def test_segment_edges(spark):
    """Markers leave out neighbours and edges, unless asked for."""
    d = spark.createDataFrame([(1, a, b, -1.0 if (a, b) == (1, 3) else 0.1) for a, b in itertools.combinations(range(5), 2)], "trace long, a long, b long, domain_dist double")
    s = spark.createDataFrame([(1, k) for k in range(5)], "trace long, segment long")
    assert {(r.a, r.b) for r in interaction.markers(d, s).collect()} == {(1, 3)}
    assert interaction.markers(d, s, neighbours=True, edges=True).count() == 10


def test_decode_with_centres(spark):
    """Against a plain loop: sides by the nearest centre, product of pooled shares, centres refreshed."""
    rng = random.Random(11)
    rows = [(t, x, c, *[rng.gauss(5 * (c % 2), 1) for _ in range(3)], rng.random(), rng.random()) for t in (0, 1) for x in range(12) for c in range(4)]
    start = [(t, s, *[5.0 * (s == "B")] * 3) for t in (0, 1) for s in "AB"]
    d = spark.createDataFrame(rows, "trace long, locus long, candidate long, z double, x double, y double, brightness double, spread double")
    got = spots.decode_with_centres(d, spark.createDataFrame(start, "trace long, side string, z double, x double, y double"), 3).collect()
    centres, chosen = {(t, s): p for t, s, *p in start}, None
    for _ in range(3):
        near = [(r, *min((round(math.dist(r[3:6], centres[r[0], s]), 12), s) for s in "AB")) for r in rows]
        pool = near if chosen is None else chosen
        share = lambda v, key: sum(key(x) <= v for x in pool) / len(pool)  # noqa: E731, B023
        keys = [lambda x: x[0][6], lambda x: x[0][7], lambda x: x[1]]
        score = {x[0][:3]: share(keys[0](x), keys[0]) * (1.001 - share(keys[1](x), keys[1])) * (1.001 - share(keys[2](x), keys[2])) for x in near}
        best = {}
        for x in sorted(near, key=lambda x: (-score[x[0][:3]], x[0][2])):
            best.setdefault((x[0][0], x[0][1], x[2]), x)
        chosen = list(best.values())
        centres = {k: [float(np.median([x[0][3 + i] for x in chosen if (x[0][0], x[2]) == k])) for i in range(3)] for k in centres}
    assert {(r.trace, r.locus, r.candidate, r.side) for r in got} == {(*x[0][:3], x[2]) for x in chosen}


def test_balanced_codes():
    all_codes = list(itertools.combinations(range(8), 2))
    regions = [c for c in range(3) for _ in range(8)]
    found, spread = codes.balanced_codes(regions, all_codes, 8, 4000)
    assert len(set(found.values())) == 24 and set(found) == set(range(24))
    load = [[sum(r in found[i] for i in range(24) if regions[i] == c) for r in range(8)] for c in range(3)]
    assert spread == pytest.approx(max(np.std(v) for v in load)) and spread <= 0.75
    with pytest.raises(ValueError):
        codes.balanced_codes([0] * 40, all_codes, 8)


def plain_clusters(xyz, reach, least):
    near = [[j for j in range(len(xyz)) if math.dist(xyz[i], xyz[j]) <= reach] for i in range(len(xyz))]
    label = [-1] * len(xyz)
    k = 0
    for i in range(len(xyz)):
        if label[i] < 0 and len(near[i]) >= least:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    todo += [x for x in near[j] if len(near[x]) >= least and label[x] < 0]
            k += 1
    for i in range(len(xyz)):
        if label[i] < 0:
            cores = [j for j in near[i] if len(near[j]) >= least]
            label[i] = label[cores[0]] if cores else -1
    return label


def test_clusters_and_fusion(spark):
    rng = np.random.default_rng(12)
    for least in (2, 4):
        xyz = rng.random((60, 3))
        assert interaction.labels_of(xyz, 0.2, least).tolist() == plain_clusters(xyz.tolist(), 0.2, least)
    rows = [(1, i, float(10 * (i // 5 in (0, 1))), 0.1 * (i % 5), 0.0) for i in range(15)] + [(1, 20, None, None, None)]
    cuts = spark.createDataFrame([(1, k, 5 * k, 5 * k + 4) for k in range(3)], "trace long, segment long, first long, last long")
    assert [tuple(r) for r in interaction.fused_by_clusters(spark.createDataFrame(rows, POINT), cuts, 0.5).collect()] == [(1, 0, 1)]


def test_merging_by_contact_and_candidates(spark):
    rng = np.random.default_rng(13)
    centre = [(0, 0, 0), (0.5, 0, 0), (9, 9, 0)]
    rows = [(1, i, *(float(x) for x in centre[i // 10] + rng.normal(0, 0.3, 3))) for i in range(30)]
    rows[25] = (1, 25, None, None, None)
    p = spark.createDataFrame(rows, POINT)
    cuts = spark.createDataFrame([(1, k, 5 * k, 5 * k + 4) for k in range(6)], "trace long, segment long, first long, last long")
    got = interaction.merged_by_contact(p, cuts, 1.5, 0.5).orderBy("segment").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 19), (20, 29)]
    scored = spark.createDataFrame([(1, i, 3.0 if i in (8, 20) else 0.0) for i in range(30)], "trace long, c long, score double")
    found = {r.c for r in interaction.candidate_boundaries(scored, p, 5).collect()}
    xyz = np.column_stack([segments.filled(np.array([np.nan if r[k] is None else r[k] for r in rows])) for k in (2, 3, 4)])
    corr = np.corrcoef(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)))
    change = [float(np.linalg.norm(corr[i - 5 : i] - corr[i : i + 5])) for i in range(5, 25)]
    assert found == {0} | {p + 5 for p, *_ in plain_peaks(change, 5, 0, 0) if min(abs(p + 5 - 8), abs(p + 5 - 20)) <= 1} and 20 in found


def test_exchange_settles(spark):
    rows = [(1, a, b, float(a + b)) for a, b in itertools.combinations(range(6), 2)]
    judged = spark.createDataFrame(rows, "trace long, a long, b long, likelihood double")
    called = spark.createDataFrame([(1, 0, 1), (1, 4, 5), (1, 3, 5), (1, 8, 9)], "trace long, a long, b long")
    sel, exc = [1.0, 9.0, 8.0], [a + b for a, b in itertools.combinations(range(6), 2) if (a, b) not in ((0, 1), (4, 5), (3, 5))]
    low, high = np.percentile(sel, 5), np.percentile(exc, 95)
    low, high = low + 0.1 * (high - low), high - 0.1 * (high - low)
    want = {(a, b) for a, b in itertools.combinations(range(6), 2) if (a + b >= low if (a, b) in ((0, 1), (4, 5), (3, 5)) else a + b > high)}
    assert {(r.a, r.b) for r in interaction.exchanged(called, judged).collect()} == want and (0, 1) not in want
    good = spark.createDataFrame([(1, 4, 5), (1, 3, 5), (1, 2, 5), (1, 3, 4), (1, 1, 5)], "trace long, a long, b long")
    few = judged.filter("a + b < 5").unionByName(judged.filter("a + b > 5"))
    assert {(r.a, r.b) for r in interaction.exchanged(good, few).collect()} == {(4, 5), (3, 5), (2, 5), (3, 4), (1, 5)}


def test_pick_by_em(spark):
    """Against a plain loop: cdf of brightness less that of the distance from the median of the picks."""
    rng = random.Random(14)
    rows = [(t, x, c, *[rng.gauss(0, 1) for _ in range(3)], float(rng.randint(0, 30))) for t in (0, 1) for x in range(15) for c in range(4)]
    got, moved = decode.pick_by_em(spark.createDataFrame(rows, "trace long, locus long, candidate long, z double, x double, y double, brightness double"), 4, 0.0)
    want = set()
    for t in (0, 1):
        own = [r for r in rows if r[0] == t]
        share = lambda values, v: sum(x <= v for x in values) / len(values)
        light = {r[:3]: share([q[6] for q in own], r[6]) for r in own}

        def best(score):
            return {x: max((r for r in own if r[1] == x), key=lambda r: (score[r[:3]], -r[2])) for x in range(15)}  # noqa: B023

        picks = best(light)
        for _ in range(len(moved)):
            centre = np.median([r[3:6] for r in picks.values()], axis=0)
            off = {r[:3]: math.sqrt(sum((a - b) ** 2 for a, b in zip(r[3:6], centre, strict=True))) for r in own}
            picks = best({k: light[k] - share(list(off.values()), off[k]) for k in off})
        want |= {r[:3] for r in picks.values()}
    assert {(r.trace, r.locus, r.candidate) for r in got.collect()} == want and len(moved) >= 1


def test_complete_linkage(spark):
    rng = random.Random(15)
    rows = [(t, i, *[rng.random() for _ in range(3)]) for t in (0, 1) for i in range(25)] + [(0, 90, None, 1.0, 1.0)]
    got = {(r.trace, r.locus): r.cluster for r in spots.clusters(spark.createDataFrame(rows, POINT), 0.6).collect()}
    for t in (0, 1):
        parts = [[r] for r in rows if r[0] == t and r[2] is not None]
        while len(parts) > 1:
            far = lambda a, b: max(math.dist(p[2:], q[2:]) for p in a for q in b)
            d, i, j = min((far(parts[i], parts[j]), i, j) for i, j in itertools.combinations(range(len(parts)), 2))
            if d > 0.6:
                break
            parts[i] += parts.pop(j)
        assert {frozenset(r[1] for r in p) for p in parts} == {frozenset(x for (u, x), c in got.items() if u == t and c == k) for k in {c for (u, _), c in got.items() if u == t}}


def test_code_tails(spark):
    """By hand: outer ends count on their own, an inner end is the one before it, and bits are used in turn."""
    rows = [("g", p, k, "AC") for p, n in ((1, 3), (2, 2), (3, 1)) for k in range(n)]
    tails = ["A" * 15 + "C", "C" * 15 + "G", "G" * 15 + "T"]
    got = codes.tailed(spark.createDataFrame(rows, "gene string, pair long, place long, sequence string"), [0, 2], tails).orderBy("pair", "place").collect()
    assert [(r.pair, r.place, r.left, r.right) for r in got] == [(1, 0, "i_0", "v_0"), (1, 1, "v_0", "v_2"), (1, 2, "v_2", "i_2"), (2, 0, "i_0", "v_0"), (2, 1, "v_0", "i_2"), (3, 0, "i_0", "v_2")]
    assert got[0].sequence == "G" + "GT" + "T" * 15 and got[5].sequence == "G" + "GT" + "C" * 15
    short = codes.tailed(spark.createDataFrame(rows, "gene string, pair long, place long, sequence string"), [0, 2], tails, limit=1).count()
    assert short == 3


def test_exchange_loop_and_insulation_starts(spark):
    """The loop ends where one more exchange changes nothing, as rounds done one by one; insulation cuts stand at the wide peaks."""
    rng = np.random.default_rng(16)
    rows = [(t, i, *(float(x) for x in rng.random(3))) for t in (0, 1) for i in range(40)]
    p = spark.createDataFrame(rows, POINT)
    cuts = spark.createDataFrame([(t, k, 5 * k, 5 * k + 4) for t in (0, 1) for k in range(8)], "trace long, segment long, first long, last long")
    found = segments.segment_point_pairs(p, cuts)
    start = segments.domain_distances(found, "insulation").filter("domain_dist < 1 and domain_dist > 0").select("trace", "a", "b")
    told = lambda df: {tuple(r) for r in df.collect()}
    now = told(start)
    for _ in range(3):
        frame = spark.createDataFrame(sorted(now), "trace long, a long, b long")
        new = told(interaction.exchanged(frame, interaction.likelihoods(found, frame)))
        settled = {t for t in (0, 1) if {x for x in new if x[0] == t} == {x for x in now if x[0] == t}}
        if new == now:
            break
        now = new
    assert now and told(interaction.called_by_likelihood(found, start, 3, w_within=1.0)) == {(*x, x[0] in settled) for x in now}
    touch = {(r.trace, r.a, r.b) for r in interaction.in_contact(found, 0.7, 0.6).collect()}
    once = told(interaction.exchanged(start, interaction.likelihoods(found, start, w_called=1.0, w_within=0.05), percent=1.0, rate=0.3)) & touch
    got = interaction.called_by_likelihood(found, start, 1, cutoff=0.7, share=0.6, percent=1.0, rate=0.3)
    assert once and {(r.trace, r.a, r.b) for r in got.collect()} == once
    plain = {}
    for r in found.collect():
        plain.setdefault((r.trace, r.seg_i, r.seg_j), []).append(r.dist)
    sums = lambda t, k, of: [d for (u, i, j), v in plain.items() if u == t and i != j and k in (i, j) and ((i + j - k) in of) for d in v]
    fit = lambda v: (np.mean(v), np.var(v))
    log = lambda v, m, s: np.mean([-((x - m) ** 2) / (2 * s) - math.log(s) / 2 - math.log(2 * math.pi) / 2 for x in v])
    pairs = told(start)
    for r in interaction.likelihoods(found, start, w_called=0.7, w_within=0.2).collect()[:12]:
        want = 0.0
        for own, other in ((r.a, r.b), (r.b, r.a)):
            of = {x for t, x, y in pairs if t == r.trace and y == own} | {y for t, x, y in pairs if t == r.trace and x == own}
            one, two = fit(sums(r.trace, own, of)), fit(sums(r.trace, own, set(range(8)) - of - {own}))
            inner = plain[r.trace, own, own]
            size = round((1 + math.sqrt(1 + 8 * len(inner))) / 2)
            three = fit([*inner, *inner, *[0.0] * size])
            v = plain[r.trace, min(own, other), max(own, other)]
            want += 0.7 * (log(v, *one) - log(v, *two)) + 0.2 * (log(v, *three) - log(v, *two))
        assert r.likelihood == pytest.approx(want)
    v = [float(x) for x in rng.random(60)]
    scored = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "trace long, c long, score double")
    got = interaction.sliding_domains(scored, p, 4, 0.03, merge=False, width=1.0).collect()
    assert {r["first"] for r in got} == {0} | {q for q, *_ in plain_peaks(v, 4, 0.03, 1.0)}
