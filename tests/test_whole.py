"""Queries and operators that do the whole job, against plain versions on small tables."""

import collections
import itertools
import math
import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillspan.operators import decode, joins, sequences, spots
from quillspan.plans import catalog, more, wider  # noqa: F401

SF = "/root/testdata/sf0.001"
POINT = "trace long, locus long, z double, x double, y double"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def split(rows):
    """(covered, spread) of the best pair of centres of (locus, place) rows, and the sides' medians."""
    best = None
    for one in range(1, len(rows)):
        for other in range(one):
            second = [math.dist(rows[one][1], p) > math.dist(rows[other][1], p) for _, p in rows]
            loci = [{l for (l, _), s in zip(rows, second, strict=True) if s == side} for side in (False, True)]
            means = [[math.dist(rows[c][1], p) for (_, p), s in zip(rows, second, strict=True) if s == side] for c, side in ((one, False), (other, True))]
            spread = sum(np.mean(m) if m else math.inf for m in means)
            if best is None or (len(loci[0] & loci[1]), -spread) > best[:2]:
                best = (len(loci[0] & loci[1]), -spread, [np.median([p for (_, p), s in zip(rows, second, strict=True) if s == side], axis=0) for side in (False, True)])
    return best


def test_homolog_centres(spark):
    rng = random.Random(3)
    rows = [(g, x, c, *[rng.gauss(4 * (c % 2), 1) for _ in range(3)]) for g in (0, 1) for x in range(6) for c in range(3)] + [(1, 9, 0, None, None, None), (2, 0, 0, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in spots.homolog_centres(spark.createDataFrame(rows, "g long, x long, candidate long, z double, x2 double, y double").select("g", F.col("x").alias("at"), "candidate", "z", F.col("x2").alias("x"), "y"), "g", "at").collect()}
    assert set(got) == {0, 1}
    for g, r in got.items():
        covered, spread, sides = split([(x, p) for h, x, _, *p in rows if h == g and p[0] is not None])
        assert (r.covered, r.spread) == (covered, pytest.approx(-spread))
        assert [r.z1, r.x1, r.y1, r.z2, r.x2, r.y2] == pytest.approx([*sides[0], *sides[1]])


def test_k_nearest_is_exact(spark):
    rng = random.Random(5)
    a, b = ([(rng.randint(0, 1), i, rng.choice([rng.random(), 50 * rng.random()]), rng.random()) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(a + [(0, 99, None, 1.0)], "g long, a long, x double, y double"), spark.createDataFrame(b, "g long, b long, x double, y double")
    got = {(r.g, r.a, r.rank): r.b for r in joins.k_nearest(left, right, ["x", "y"], ["g"], "a", "b", 4, 0.05).collect()}
    want = {(g, i, k + 1): j for g, i, *p in a for k, (_, j) in enumerate(sorted((math.dist(p, q), j) for h, j, *q in b if h == g)[:4])}
    assert got == want


def plain_component(xyz):
    r = np.eye(len(xyz))
    for i, j in itertools.permutations(range(len(xyz)), 2):
        if np.ptp(xyz[i]) and np.ptp(xyz[j]):
            r[i, j] = np.corrcoef(xyz[i], xyz[j])[0, 1]
    m = r - r.mean(0)
    v = np.linalg.eigh(m.T @ m)[1][:, -1]
    return v * np.sign(v[np.abs(v).argmax()])


def test_first_component(spark):
    rng = np.random.default_rng(4)
    xyz = {t: rng.random((90, 3)) for t in (0, 1)}
    xyz[1][[3, 70, 80]] = [[0.5] * 3, [0.1] * 3, [0.2] * 3]  # constant points
    rows = [(t, i, *map(float, p)) for t, all_ in xyz.items() for i, p in enumerate(all_)] + [(0, 95, None, 1.0, 2.0), (2, 0, None, None, None)]
    got = decode.first_component_of(spark.createDataFrame(rows, POINT), ["z", "x", "y"]).collect()
    assert len(got) == 180
    for t in xyz:
        v = np.array([r.pc1 for r in sorted(got, key=lambda r: r.locus) if r.trace == t])
        assert v == pytest.approx(plain_component(xyz[t]), abs=1e-8)


@needs_tables
def test_pca1_takes_all_loci(spark):
    points = [r for r in catalog.points(spark, SF).collect() if r.z is not None]
    got = {(r.trace, r.locus): r.pc1 for r in catalog.QUERIES["pca1"](spark, SF).collect()}
    assert max(x for _, x in got) >= 60 and set(got) == {(r.trace, r.locus) for r in points}
    for t in {r.trace for r in points}:
        own = sorted((r for r in points if r.trace == t), key=lambda r: r.locus)
        want = plain_component(np.array([(r.z, r.x, r.y) for r in own]))
        assert [got[t, r.locus] for r in own] == pytest.approx(want, abs=1e-8)


def test_binned_overlaps(spark):
    rng = random.Random(6)
    a, b = ([(i, rng.randint(0, 2), float(low), float(low + rng.randint(0, 40))) for i in range(60) for low in [rng.randint(-50, 50)]] for _ in range(2))
    left, right = spark.createDataFrame(a, "i long, g long, start double, end double"), spark.createDataFrame(b, "j long, g long, s double, e double")
    got = sorted((r.i, r.j) for r in joins.binned_overlaps(left, right, ["g"], 8.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])


@needs_tables
def test_no_side_is_cut_by_ids(spark):
    points = catalog.points(spark, SF).collect()
    screened = set()
    for p in points:
        reference = [r for r in points if r.trace == p.trace + 1 and r.label == p.label and r.z is not None]
        if not reference or p.z is not None and any(math.dist((p.z, p.x, p.y), (r.z, r.x, r.y)) <= 0.3 for r in reference):
            screened.add((p.trace, p.locus))
    assert {(r.trace, r.locus) for r in catalog.QUERIES["spot_screening"](spark, SF).collect()} == screened


def test_unused_pairs(spark):
    codes = spark.createDataFrame([(i,) for i in range(6)], "code int")
    used = spark.createDataFrame([(0, 1), (2, 5)], "a int, b int")
    assert {tuple(r) for r in sequences.unused_pairs(codes, used).collect()} == set(itertools.combinations(range(6), 2)) - {(0, 1), (2, 5)}
    with pytest.raises(ValueError):
        sequences.unused_pairs(codes, used, most=5)


def test_unused_pairs_of_many_codes(spark):
    codes = spark.range(12_000).select(F.col("id").alias("code"))
    used = spark.range(12_000).filter("id > 0").select(F.lit(0).alias("a"), F.col("id").alias("b"))
    free = sequences.unused_pairs(codes, used.unionByName(used))
    assert tuple(free.agg(F.count("*"), F.min("a"), F.sum(F.col("b") - F.col("a"))).first()) == (11_999 * 11_998 // 2, 1, sum(d * (11_999 - d) for d in range(11_999)))
    few = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "code string")
    assert sorted(map(tuple, sequences.unused_pairs(few, spark.createDataFrame([("a", "c")], "a string, b string"), block=1).collect())) == [("a", "b"), ("b", "c")]


def test_unused_pairs_send_no_blocks_to_all_tasks(spark, tmp_path):
    """Blocks of codes are not broadcast, however small their files; more blocks than ``parts`` become larger ones; used pairs of either order of blocks."""
    spark.createDataFrame([(i * 7 % 101,) for i in range(101)] + [(5,), (None,)], "code long").write.parquet(str(tmp_path / "codes"))
    codes = spark.read.parquet(str(tmp_path / "codes"))
    pairs = {(a, b) for a, b in itertools.combinations(range(101), 2) if a % 9 == 0 or (a * b) % 5 == 1}
    used = spark.createDataFrame([*sorted(pairs), (4, 3), (8, 8), (1, 500), (None, 2)], "a int, b int")
    for parts in ({}, {"parts": 1}, {"parts": 4}):
        free = sequences.unused_pairs(codes, used, block=3, **parts)
        assert sorted(map(tuple, free.collect())) == sorted(set(itertools.combinations(range(101), 2)) - pairs)
        plan = free._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" not in x]


def test_matches_move_points_once(spark):
    """Regions are only dealt to blocks of points and points to none but their own; pairs by slices of blocks of any size against every pair."""
    n = 3000
    many = spark.range(n).select(F.col("id").alias("region"), F.lit(1).alias("g"), F.col("id").alias("start"), (F.col("id") + n).alias("end"))
    found = joins.matched_in_interval(many.select(F.col("region").alias("id"), "g", (F.col("start") + 1).alias("place")), many, "place", ["g"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # blocks of a region, pairs
    assert found.count() == n * (n + 1) // 2 + n - 2
    rng = random.Random(8)
    places = [(i, rng.choice("xy"), rng.choice([None, *range(12)]) if i % 3 else 5) for i in range(120)]
    regions = [(i, rng.choice("xyz"), a, a + rng.choice([-1, 0, 1, 4, 20])) for i, a in enumerate(rng.randrange(-3, 12) for _ in range(60))]
    regions += regions[:1]
    p, r = spark.createDataFrame(places, "id long, g string, place long"), spark.createDataFrame(regions, "region long, g string, start long, end long")
    for closed, block, keep in (("left", 1, None), ("both", 7, ["id"]), ("left", 50, ["id", "place"]), ("both", 32_768, None)):
        want = [(x[0], y[0]) for x in places for y in regions if x[2] is not None and x[1] == y[1] and y[2] <= x[2] and (x[2] < y[3] or closed == "both" and x[2] == y[3])]
        got = joins.matched_in_interval(p, r, "place", ["g"], closed, keep=keep, block=block)
        assert sorted((x.id, x.region) for x in got.collect()) == sorted(want)


def test_snapped_meets_only_near_references(spark):
    rows = [(g, x) for g in (1, 2) for x in range(-20, 20) if random.Random(g * 100 + x).random() < 0.3]
    starts = spark.createDataFrame(rows, "g long, start long")
    refs = spark.createDataFrame([(g, -x) for g, x in rows], "g long, ref long")
    for reach in (0, 1, 3, 7.5):
        near = {(g, x): [-y for h, y in rows if h == g and abs(x + y) <= reach] for g, x in rows}
        assert sorted((r.g, r.start, r.ref) for r in spots.snapped(starts, refs, ["g"], reach).collect()) == sorted((*k, v[0]) for k, v in near.items() if len(v) == 1)
    n = 60_000
    many = spark.range(n).select(F.lit(1).alias("g"), (10 * F.col("id")).alias("start"))
    found = spots.snapped(many, many.select("g", (F.col("start") + 1).alias("ref")), ["g"], 3)
    assert found.filter("ref = start + 1").count() == n


def test_overlapping_counts(spark):
    """A mark counts where one of its ends lies, by the share of the mark inside; one that covers a region whole does not count."""
    regions = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 1, 10.0, 20.0), (3, 2, 0.0, 5.0)], "region long, g long, start double, end double")
    marks = spark.createDataFrame([(1, 1, 5.0, 15.0), (2, 1, -5.0, 30.0), (3, 1, 18.0, 28.0), (4, 1, 2.0, 4.0), (5, 2, 9.0, 9.5)], "id long, g long, s double, e double")
    got = {r.region: r.n for r in joins.overlapping_counts(regions, marks, "region", "id", ["g"], 4.0).collect()}
    assert got == pytest.approx({1: 0.5 + 1.0, 2: 0.5 + 0.2, 3: 0.0})


def test_regions_of_places_without_pairs(spark):
    """Least and greatest region, all pairs, counts, folds and shares against every pair; 20,000 places that 20,000 regions hold make no pairs."""
    rng = random.Random(3)
    number = lambda: rng.choice([None, *[x / 4 for x in range(-8, 60)]])
    places = [(rng.randint(0, 60), rng.choice([None, 1, 2]), number(), rng.randint(0, 9)) for _ in range(90)]
    regions = [(i % 60, rng.choice([None, 1, 2]), a, None if a is None else a + rng.choice([-1, 0, 0.25, 3, 20])) for i, a in enumerate(number() for _ in range(80))]
    p = spark.createDataFrame(places, "id long, g long, place double, fold long")
    r = spark.createDataFrame(regions, "region long, g long, start double, end double")
    for closed in ("left", "both"):
        holds = lambda x, y: None not in (x[1], x[2], y[2]) and x[1] == y[1] and y[2] <= x[2] and (x[2] < y[3] or closed == "both" and x[2] == y[3])  # noqa: B023, E731
        hit = [(x, y) for x in places for y in regions if holds(x, y)]
        got = joins.matched_in_interval(p, r, "place", ["g"], closed).select("id", "fold", "region").collect()
        assert sorted(map(tuple, got)) == sorted((x[0], x[3], y[0]) for x, y in hit)
        for last, best in ((False, min), (True, max)):
            got = joins.with_region(p, r, "place", ["g"], "region", closed, last).collect()
            want = [(x[0], x[3], best(y[0] for z, y in hit if z is x)) for x in places if any(z is x for z, _ in hit)]
            assert sorted((x.id, x.fold, x.region) for x in got) == sorted(want)
        got = joins.points_in_regions(p, r, "place", ["g"], "region", closed).collect()
        assert sorted(map(tuple, got)) == sorted((y[0], sum(z[0] == y[0] for _, z in hit)) for y in regions)
    marks = [(i, rng.choice([1, 2]), a, a + rng.choice([0, 0.5, 2, 30])) for i, a in enumerate(rng.choice(range(-8, 60)) / 4 for _ in range(70))]
    m = spark.createDataFrame([*marks, marks[0]], "id long, g long, s double, e double")
    want = collections.Counter()
    for y in regions:
        for _, g, s, e in [*marks, marks[0]]:
            if None not in (y[1], y[2]) and g == y[1] and s < e and (y[2] <= s < y[3] or y[2] <= e < y[3]):
                want[y[0]] += (min(e, y[3]) - max(s, y[2])) / (e - s)
    for x in joins.overlapping_counts(r, m, "region", "id", ["g"], 4.0).collect():
        assert x.n == pytest.approx(want[x.region], abs=1e-9)
    n = 20_000
    many = spark.range(n).select(F.col("id").alias("region"), F.lit(1).alias("g"), (F.col("id") % 500 / 1000).alias("start"), (F.col("id") % 500 / 1000 + 1).alias("end"))
    one = spark.range(n).select("id", F.lit(1).alias("g"), (0.6 + F.col("id") % 300 / 1000).alias("place"))
    assert joins.points_in_regions(one, many, "place", ["g"], "region").agg(F.sum("n")).first()[0] == n * n
    assert joins.with_region(one, many, "place", ["g"], "region").agg(F.max("region")).first()[0] == 0


@needs_tables
def test_interdomain_markers_of_a_trace_that_ends_early(spark, tmp_path):
    """The first and last segment are those of all traces, as in the SQL."""
    import duckdb

    rows = spark.range(265).select(F.col("id").alias("vec_id"), F.array(*[(F.xxhash64("id", F.lit(i)) % 1000 / 1000).cast("float") for i in range(3)]).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(catalog.ORACLE["interdomain_markers"]).fetchall()
    assert any(t == 2 and b == 6 for t, _, b, _ in want)
    assert sorted(map(tuple, catalog.QUERIES["interdomain_markers"](spark, str(tmp_path)).collect())) == sorted(want)


def plain_em(rows, rounds):
    chosen = rows
    for _ in range(rounds):
        share = [lambda v, all_=[r[k] for r in chosen]: sum(x <= v for x in all_) / len(all_) for k in (3, 4)]
        scored = sorted(((r, share[0](r[3]) * (1 - share[1](r[4]) + 0.001)) for r in rows), key=lambda x: (x[0][:2], -x[1], x[0][2]))
        chosen = [r for _, own in itertools.groupby(scored, lambda x: x[0][:2]) for r, _ in list(own)[:2]]
    return {r[:3] for r in chosen}


def test_decode_em_with_any_values(spark):
    rng = random.Random(8)
    # brightness far above 1 with ties, spreads closer than 0.001 and above 1
    rows = [(t, x, c, float(rng.randint(1, 4000)), rng.choice([3, 70, 500]) + rng.random() / 1000) for t in (0, 1) for x in range(40) for c in range(4)]
    rows = [(*r[:3], 900.0, r[4]) if rng.random() < 0.1 else r for r in rows]
    got = spots.decode_by_em(spark.createDataFrame(rows, "trace long, locus long, candidate long, brightness double, spread double"), 3).collect()
    assert {(r.trace, r.locus, r.candidate) for r in got} == plain_em(rows, 3)
    assert len(got) == 160


def test_similar_on_both_strands(spark):
    def similar(a, b, k):
        rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
        return sum(b.count(a[i : i + k]) + rc.count(a[i : i + k]) for i in range(len(a) - k + 1))

    rng = random.Random(9)
    texts = ["AAAAAAAAAAAA", "TTTTTTTTT", "ACACACACAC", "ACG", "", "GATTACAGATTACA", "TGTAATCTGTAATC"] + ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(8)]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, s string")
    got = {(r.i, r.j): r.shared for r in sequences.similar_pairs(rows, "id", F.col("s"), 4).collect()}
    want = {(i, j): similar(texts[i], texts[j], 4) for i in range(len(texts)) for j in range(i)}
    assert got == {p: n for p, n in want.items() if n}
    assert got[1, 0] and got[6, 5]  # alike through the reverse complement only
