"""Hand-checked small cases, and plain versions of the sequential operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import columns as C
from quillspan.operators import decode, density, joins, ordered, pairs, segments
from quillspan.sources import files

POINT = "trace long, locus long, z double, x double, y double"


def test_pairs_and_contacts(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 4.0, 0.0), (1, 2, None, None, None), (1, 3, 0.0, 0.0, 12.0)], POINT)
    d = pairs.pair_distances(p)
    assert {(r.i, r.j): r.dist for r in d.filter("dist is not null").collect()} == {(0, 1): 5, (0, 3): 12, (1, 3): 13}
    one = d.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    assert pairs.contact_map(one, [12.0, 12.001]).select("p_0", "p_1").first() == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert pairs.contact_map_without_ties(one, 12.0).first().p == 0.5


def test_runs_and_gaps(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1])], "trace long, locus long, l int")
    assert [r.length for r in ordered.runs(rows, "trace", ["locus"], F.col("l")).orderBy("run").collect()] == [2, 1, 3]
    gaps = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, None, None, 3.0])], "trace long, locus long, v double")
    assert [r.filled for r in ordered.interpolated(gaps, "v").orderBy("locus").collect()] == [0, 1, 2, 3]


def test_intervals(spark):
    regions = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 20.0)], "region long, start double, end double").withColumn("g", F.lit(1))
    place = spark.createDataFrame([(7, 10.0, 1)], "id long, place double, g int")
    both = joins.binned_in_interval(place, regions, "place", ["g"], 4.0, "both")
    assert joins.first_match(both, ["id"], "region").first().region == 1
    assert joins.last_match(both, ["id"], "region").first().region == 2
    assert [r.region for r in joins.binned_in_interval(place, regions, "place", ["g"], 4.0).collect()] == [2]
    assert [r.region for r in joins.in_interval(place, regions, "place", ["g"]).collect()] == [2]


def test_unique_pairs(spark):
    a = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 10.0)], "t long, a long, x double")
    b = spark.createDataFrame([(1, 0, 0.5), (1, 1, 10.2)], "t long, b long, x double")
    near = joins.radius_join(a, b, ["x"], 1.0, ["t"], "a", "b")
    assert [(r.a, r.b) for r in joins.mutually_unique(near, ["t"], "a", "b").collect()] == [(2, 1)]


def test_density_and_size(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, "A"), (1, 1, 1.0, 0.0, 0.0, "A")], POINT + ", cls string")
    assert density.density_scores(p, "cls", 1.0).filter("locus = 0").first().density == pytest.approx(math.exp(-0.5))
    two = spark.createDataFrame([(1, 0, -1.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0)], POINT)
    assert density.gyration(two, ["trace"]).first().rg == 1


def test_sequences(spark):
    one = spark.createDataFrame([("ACGTAC", "AACG", "ACG", "ñAC")], "a string, b string, c string, d string")
    r = one.select(C.kmers(F.col("a"), 3).alias("k"), C.reverse_complement(F.col("b")).alias("r"), C.kmer_code(F.col("c")).alias("c"), C.kmers(F.col("d"), 4).alias("n"), C.kmers(F.col("d"), 2).alias("u")).first()
    assert (r.k, r.r, r.c, r.n, r.u) == (["ACG", "CGT", "GTA", "TAC"], "CGTT", 6, [], ["ñA", "AC"])


def test_best_chain_is_best(spark):
    rng = np.random.default_rng(3)
    rows = [(1, l, c, *map(float, rng.random(3)), float(rng.random())) for l in (0, 1, 3, 4) for c in range(3)]
    known = [float(x) for x in rng.random(40) * 1.5] + [float("nan")]
    steps = spark.createDataFrame([(1, x) for x in known], "trace long, dist double")
    got = decode.best_chain(spark.createDataFrame(rows, "trace long, locus long, candidate long, z double, x double, y double, score double"), steps, 0.7, 0.1, 1.4).collect()
    by = {(r[1], r[2]): r for r in rows}

    def cdf(d):
        share = lambda v: sum(x <= v for x in known[:-1]) / 40
        return min(1, max(0, (share(d) - share(0.1)) / (share(1.4) - share(0.1))))

    def total(picks):
        chain = [by[l, c] for l, c in zip((0, 1, 3, 4), picks, strict=True)]
        links = [(1 - cdf(math.dist(a[3:6], b[3:6])), b[1] - a[1]) for a, b in itertools.pairwise(chain)]
        return sum(r[6] for r in chain) + sum(0.7 * math.log(p) / gap if p else -math.inf for p, gap in links)

    best = max(itertools.product(range(3), repeat=4), key=total)
    assert tuple(r.candidate for r in sorted(got, key=lambda r: r.locus)) == best


def test_greedy_and_tile(spark):
    near = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.1), (1, 1, 1, 0.2), (1, 2, 0, 0.9)], "g long, a long, b long, dist double")
    assert sorted((r.a, r.b) for r in decode.greedy_match(near, "g").collect()) == [(0, 1), (2, 0)]
    rows = spark.createDataFrame([(1, s) for s in (0, 3, 5, 9, 12)], "g long, start long")
    assert sorted(r.start for r in decode.tile(rows, "g", "start", 4, 1).collect()) == [0, 5, 12]


def test_hull():
    box = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    assert decode.in_hull(np.array([0.5, 0.4, 0.6]), box)
    assert not decode.in_hull(np.array([1.2, 0.5, 0.5]), box)
    sets, points = np.random.default_rng(1).random((2000, 12, 3)), np.random.default_rng(2).random((2000, 3))
    together = decode.in_hulls(points, sets)
    assert 100 < together.sum() < 1900 and all(decode.in_hull(p, v) == x for p, v, x in zip(points[:200], sets, together[:200], strict=False))


def test_domains_found(spark):
    rng = np.random.default_rng(1)
    centre = [(0, 0, 0), (9, 0, 0), (0, 9, 0)]
    rows = [(1, i, *(float(x) for x in centre[i // 10] + rng.normal(0, 1, 3))) for i in range(30)]
    rows[4] = (1, 4, None, None, None)
    got = segments.merged_domains(spark.createDataFrame(rows, POINT), 5).orderBy("segment").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 9), (10, 19), (20, 29)]
    assert segments.filled(np.array([np.nan, 1.0, np.nan, 3.0, 5.0, np.nan])).tolist() == [0, 1, 2, 3, 5, 7]


def test_boundary_scores_by_hand(spark):
    """Two tight halves: across is 10, within is 1 or 2."""
    place = [0.0, 1.0, 2.0, 12.0, 13.0, 14.0]
    p = spark.createDataFrame([(1, i, v, 0.0, 0.0) for i, v in enumerate(place)], POINT)
    loci = p.select("trace", F.col("locus").alias("c"))
    across, within = [abs(a - b) for a in place[1:3] for b in place[3:5]], [1.0, 1.0]
    one = {m: {r.c: r.score for r in ordered.boundary_score(pairs.pair_distances(p), loci, 2, m).collect()} for m in ("median", "mean", "ks", "insulation", "normed_insulation")}
    assert one["insulation"][3] == pytest.approx(np.mean(across) / np.mean(within)) and one["normed_insulation"][3] == pytest.approx((1 - np.mean(across)) / (1 + np.mean(across)))
    assert one["mean"][3] == pytest.approx((np.mean(across) - 1) / np.std(across)) and one["ks"][3] == 1
    spread = np.median((np.array(across) - np.median(across)) ** 2)
    assert one["median"][3] == pytest.approx((np.median(across) - 1) / math.sqrt(spread))
    assert all(v[0] == v[5] == 0 for v in one.values())


def test_hull_probability(spark):
    box = [(1, i, *map(float, c), "A") for i, c in enumerate(itertools.product((0, 1), repeat=3))]
    rows = [*box, (1, 20, 0.5, 0.5, 0.5, "B"), (1, 21, 3.0, 0.5, 0.5, "B"), (1, 22, None, None, None, "A")]
    got = {(r.locus, r.group): r.inside for r in decode.inside_hull(spark.createDataFrame(rows, POINT + ", cls string"), "cls", 8, 3).collect()}
    assert got[20, "A"] == 1 and got[21, "A"] == 0 and got[0, "A"] is None and got[20, "B"] is None and (22, "A") not in got


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nAC\nGT\n>two\nTT\n")
    got = files.read_fasta(spark, f"file://{tmp_path}/a.fa").orderBy("ordinal").collect()
    assert [(r.name, r.sequence) for r in got] == [("one", "ACGT"), ("two", "TT")]
    (tmp_path / "m.tsv").write_text("\ta\tb\na\t1\tnan\nb\t2\t3\n")
    assert {(r.i, r.j): r.value for r in files.read_matrix(spark, str(tmp_path / "m.tsv")).collect()} == {("a", "a"): 1, ("a", "b"): None, ("b", "a"): 2, ("b", "b"): 3}
    (tmp_path / "t.tsv").write_text("Z(nm)\tX(nm)\tY(nm)\tGenomic coordinate\tChromosome copy number\n1\t2\tnan\tchr21:5-9\t4\n")
    r = files.read_traces(spark, str(tmp_path / "t.tsv")).first()
    assert (r.trace, r.chr, r.start, r.end, r.z, r.y) == (4, "chr21", 5, 9, 1, None)
    (tmp_path / "b.bed").write_text("# c\nchr1\t1\t5\tn\t2.5\n")
    assert tuple(files.read_intervals(spark, str(tmp_path / "b.bed")).first()) == ("chr1", 1, 5, 2.5)
    (tmp_path / "c.csv").write_text("hyb,750,647\nH1,u1,\nH2,,beads\n")
    assert sorted(map(tuple, files.read_color_usage(spark, str(tmp_path / "c.csv")).collect())) == [("H1", 0, "u1"), ("H2", 1, "beads")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, files.upsert(old, new, ["k"], True).collect())) == [(1, "a"), (2, "c"), (3, "d")]
