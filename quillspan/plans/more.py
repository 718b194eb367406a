"""Queries of the spot, probe and code operators; same conventions as the catalog, which they join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import columns as C
from quillspan.operators import aggregates, density, sequences, spots
from quillspan.plans.catalog import _SEQ, P, D, S, _candidates, _kmer_sql, _letters, _near, _pairs, points, query, r6, series, table

_XYZ = ["z", "x", "y"]


@query(f"""WITH {P}, c AS (SELECT a.trace, a.locus AS a, b.locus AS b, a.label AS la, b.label AS lb FROM pts a JOIN pts b ON a.trace = b.trace AND a.locus % 2 = 0 AND b.locus % 2 = 1
AND greatest(abs(a.z-b.z), abs(a.x-b.x), abs(a.y-b.y)) < 0.1) SELECT trace, locus FROM pts p WHERE locus % 2 = 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.trace = p.trace AND c.a = p.locus AND lb + 1 > 2 * (la + 1))""")
def carry_over(spark, sf):
    p = points(spark, sf)
    light = lambda s: p.select("trace", F.col("locus").alias(s), (F.col("label") + 1).alias("brightness" if s == "a" else "other"))
    near = _near(spark, sf, 0.1, norm="box", strict=True).join(light("a"), ["trace", "a"]).join(light("b"), ["trace", "b"])
    later = p.filter("locus % 2 = 0").withColumnRenamed("locus", "a")
    return spots.without_carry_over(later, near, ["trace", "a"], 2.0).select("trace", F.col("a").alias("locus"))


@query(f"WITH {P}, m AS (SELECT label, avg(z) AS z, avg(x) AS x, avg(y) AS y FROM pts WHERE label < 8 GROUP BY 1) SELECT trace, locus, round(p.z - coalesce(m.z, 0), 6) AS z, round(p.x - coalesce(m.x, 0), 6) AS x, round(p.y - coalesce(m.y, 0), 6) AS y FROM pts p LEFT JOIN m USING (label)")
def drift_correct(spark, sf):
    p = points(spark, sf)
    drift = p.filter("label < 8").groupBy("label").agg(*[F.avg(c).alias(c) for c in _XYZ])
    return spots.corrected(p, drift, ["label"], _XYZ).select("trace", "locus", *r6(*_XYZ))


@query(f"WITH {P} SELECT trace, locus, round(1 + 2*z + 3*x + 4*z*z + 5*z*x + 6*x*x, 6) AS warped FROM pts")
def chromatic_polynomial(spark, sf):
    return points(spark, sf).select("trace", "locus", F.round(spots.polynomial([F.col("z"), F.col("x")], [1, 2, 3, 4, 5, 6], 2), 6).alias("warped"))


@query(f"WITH {P} SELECT trace, locus, CASE WHEN locus % 5 = 0 THEN 99 ELSE label END AS label FROM pts")
def recombined(spark, sf):
    p = points(spark, sf).select("trace", "locus", "label")
    return spots.replaced(p, p.filter("locus % 5 = 0").withColumn("label", F.lit(99).cast("long")), ["trace", "locus"], ["label"])


@query(f"WITH {P}, d AS (SELECT sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM pts a JOIN pts b ON b.trace = a.trace + 1 AND a.locus = b.locus) SELECT round(avg((d >= 0.2)::INT), 6) AS changed, count(d) AS n FROM d")
def evaluate_differences(spark, sf):
    p = points(spark, sf)
    other = p.withColumn("trace", F.col("trace") - 1)
    return spots.share_changed(p, other, ["trace", "locus"], _XYZ, 0.2).select(*r6("changed"), "n")


@query(f"""WITH {P} SELECT trace, locus, label FROM pts p WHERE EXISTS (SELECT 1 FROM pts r WHERE r.trace = p.trace + 1 AND r.label = p.label AND sqrt((p.z-r.z)*(p.z-r.z)+(p.x-r.x)*(p.x-r.x)+(p.y-r.y)*(p.y-r.y)) <= 0.3)
OR NOT EXISTS (SELECT 1 FROM pts r WHERE r.trace = p.trace + 1 AND r.label = p.label AND r.z IS NOT NULL)""")
def spot_screening(spark, sf):
    """All points, screened against all points of the next trace."""
    p = points(spark, sf)
    reference = p.withColumn("trace", F.col("trace") - 1)
    return spots.near_reference(p, reference, ["trace", "label"], _XYZ, 0.3, keep_without=True).select("trace", "locus", "label")


@query("""WITH b AS (SELECT p_brand AS g, p_partkey AS s, q.p_partkey AS ref, count(*) OVER (PARTITION BY p_brand, p.p_partkey) AS n FROM part p JOIN part q USING (p_brand) WHERE p.p_size <= 25 AND q.p_size > 25 AND abs(p.p_partkey - q.p_partkey) <= 60)
SELECT g, s AS "start", ref FROM b WHERE n = 1""".replace("p_partkey AS s", "p.p_partkey AS s").replace("p_brand AS g", "p.p_brand AS g").replace("PARTITION BY p_brand,", "PARTITION BY p.p_brand,"))
def fit_boundaries(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "g")
    a, b = p.filter("p_size <= 25").select("g", F.col("p_partkey").alias("start")), p.filter("p_size > 25").select("g", F.col("p_partkey").alias("ref"))
    return spots.snapped(a, b, ["g"], 60).select("g", "start", "ref")


_RC = " + ".join(f"pow(count_if(l_linenumber = {r}) - count(*) / 7.0, 2)" for r in range(1, 8))


@query(f"SELECT l_suppkey, round(sqrt(({_RC}) / 7), 6) AS spread FROM lineitem GROUP BY 1")
def load_balance(spark, sf):
    codes = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 1).alias("round"))
    return spots.load_balance(codes, ["l_suppkey"], 7).select("l_suppkey", *r6("spread"))


@query(f"SELECT item_id, i::INT AS piece, substring(s, i * 42 + 1, 42) AS sequence FROM (SELECT item_id, s, unnest(range(0, ceil(length(s) / 42.0)::BIGINT)) AS i FROM (SELECT item_id, {_SEQ} AS s FROM benchmark))")
def split_pieces(spark, sf):
    return spots.pieces(table(spark, sf, "benchmark"), "item_id", _letters(), 42)


@query(f"SELECT item_id, 'ACGT' || reverse(translate(left(s, length(s) // 2), 'ACGT', 'TGCA')) || substr(s, length(s) // 2 + 1) || 'TTTT' AS probe FROM (SELECT item_id, {_SEQ} AS s FROM benchmark)")
def assemble_probes(spark, sf):
    s = _letters()
    half = F.floor(F.length(s) / 2).cast("int")
    parts = [F.lit("ACGT"), C.reverse_complement(F.left(s, half)), F.substring(s, half + 1, F.length(s)), F.lit("TTTT")]
    return sequences.assembled(table(spark, sf, "benchmark"), parts).select("item_id", "probe")


@query("SELECT p_partkey, (p_partkey % 3)::BIGINT AS channel, s_name AS readout FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)")
def readout_channels(spark, sf):
    readouts = table(spark, sf, "supplier").withColumn("n", F.col("s_suppkey"))
    return spots.dealt_readouts(table(spark, sf, "part"), readouts, "p_partkey", "s_name", 3).select("p_partkey", "channel", "readout")


@query("SELECT c_mktsegment, c_nationkey, c AS chunk, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members, count(*) AS n FROM (SELECT *, (rank() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1) // 5 AS c FROM customer) GROUP BY 1, 2, 3")
def partition_map(spark, sf):
    return aggregates.members(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 5)


@query("""WITH r AS (SELECT l_partkey, l_linenumber % 2 AS k, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT a.l_partkey, round(a.m / nullif(b.m, 0), 6) AS ratio FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.k = 0 AND b.k = 1""")
def quantify_repeats(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.col("l_linenumber") % 2)
    return spots.repeat_ratios(rows, "l_partkey", "k", "l_quantity").select("l_partkey", *r6("ratio"))


@query(f"WITH {S} SELECT trace, round(avg((n > 1)::INT), 6) AS share_ambiguous FROM (SELECT trace, event_type, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1")
def coverage_error(spark, sf):
    return spots.share_ambiguous(series(spark, sf), ["trace"], "event_type").select("trace", *r6("share_ambiguous"))


@query(f"WITH {P} SELECT trace, label, round(median(z), 6) AS z, round(median(x), 6) AS x, round(median(y), 6) AS y FROM pts WHERE z IS NOT NULL GROUP BY 1, 2")
def homolog_centers(spark, sf):
    return spots.median_centres(points(spark, sf), ["trace", "label"], _XYZ).select("trace", "label", *r6(*_XYZ))


@query(f"""WITH {P}, g AS (SELECT cls, floor(z * 10)::BIGINT AS cz, floor(x * 10)::BIGINT AS cx, count(*) AS n FROM pts WHERE z IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT a.n AS d1, b.n AS d2 FROM (SELECT * FROM g WHERE cls = 'A') a FULL JOIN (SELECT * FROM g WHERE cls = 'B') b ON a.cz = b.cz AND a.cx = b.cx) SELECT round(sum(sqrt(d1 * d2)) / sqrt(sum(d1) * sum(d2)), 6) AS overlap FROM j""")
def density_overlaps(spark, sf):
    g = points(spark, sf).filter("z is not null").groupBy("cls", F.floor(F.col("z") * 10).alias("cz"), F.floor(F.col("x") * 10).alias("cx")).agg(F.count("*").alias("density"))
    return density.density_overlap(g.filter("cls = 'A'"), g.filter("cls = 'B'"), ["cz", "cx"]).select(*r6("overlap"))


@query(f"WITH {_kmer_sql('k', 'item_id', 'benchmark', 6)} SELECT DISTINCT kmer, item_id FROM k")
def index_table(spark, sf):
    return sequences.inverted_index(table(spark, sf, "benchmark"), "item_id", _letters(), 6).select("kmer", "item_id")


@query(f"""WITH {_kmer_sql('k', 'item_id', 'benchmark', 8)}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1), h AS (SELECT item_id, sum(n)::BIGINT AS hits FROM k JOIN c USING (kmer) GROUP BY 1),
r AS (SELECT item_id % 4 AS region, item_id, hits, row_number() OVER (PARTITION BY item_id % 4 ORDER BY hits, item_id) AS r FROM h) SELECT region, item_id, hits FROM r WHERE r <= 5""")
def screen_by_hit(spark, sf):
    b = table(spark, sf, "benchmark")
    counts = sequences.kmer_counts(b, "item_id", _letters(), 8)
    hits = sequences.off_target_hits(b, counts, "item_id", _letters(), 8).withColumn("region", F.col("item_id") % 4)
    return sequences.fewest_hits(hits, ["region"], "item_id", 5).select("region", "item_id", "hits")


_E = "sqrt(({0}.z-p.z)*({0}.z-p.z)+({0}.x-p.x)*({0}.x-p.x)+({0}.y-p.y)*({0}.y-p.y))"


@query(f"""WITH {P}, n AS (SELECT trace * 10 + label AS g, locus // 4 AS l, z, x, y, row_number() OVER (PARTITION BY trace, label ORDER BY locus) AS k FROM pts WHERE z IS NOT NULL),
e AS (SELECT a.g, a.k AS one, b.k AS other, p.l, p.z, p.x, p.y, {_E.format("a")} AS d1, {_E.format("b")} AS d2 FROM n a JOIN n b ON a.g = b.g AND b.k < a.k JOIN n p ON p.g = a.g),
s AS (SELECT g, one, other, l, bool_or(d1 > d2) AND bool_or(d1 <= d2) AS halves FROM e GROUP BY ALL), c AS (SELECT g, one, other, count_if(halves) AS covered FROM s GROUP BY ALL),
r AS (SELECT g, one, other, avg(d1) FILTER (d1 <= d2) + avg(d2) FILTER (d1 > d2) AS spread, median(z) FILTER (d1 <= d2) AS z1, median(x) FILTER (d1 <= d2) AS x1, median(y) FILTER (d1 <= d2) AS y1, median(z) FILTER (d1 > d2) AS z2, median(x) FILTER (d1 > d2) AS x2, median(y) FILTER (d1 > d2) AS y2 FROM e GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY covered DESC, spread NULLS LAST, one, other) AS t FROM c JOIN r USING (g, one, other))
SELECT g AS "group", covered::BIGINT AS covered, round(spread, 6) AS spread, round(z1, 6) AS z1, round(x1, 6) AS x1, round(y1, 6) AS y1, round(z2, 6) AS z2, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM t WHERE t = 1""")
def homolog_split(spark, sf):
    """Groups are (trace, label); four loci are the candidates of one."""
    c = points(spark, sf).select((F.col("trace") * 10 + F.col("label")).alias("group"), F.floor(F.col("locus") / 4).alias("at"), (F.col("locus") % 4).alias("candidate"), *_XYZ)
    return spots.homolog_centres(c, "group", "at").select("group", "covered", *r6("spread", "z1", "x1", "y1", "z2", "x2", "y2"))


_DP = "sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
_VOTE = ", ".join(f"a.{c}1 - b.{c}{{0}} AS {c}" for c in "zxy")


@query(f"""WITH {P}, f AS (SELECT trace * 10 + label AS g, locus AS id, z, x, y FROM pts WHERE locus % 2 = 0 AND z IS NOT NULL), t AS (SELECT trace * 10 + label AS g, locus AS id, z, x, y FROM pts WHERE locus % 2 = 1 AND z IS NOT NULL),
pf AS (SELECT a.g, a.z AS z1, a.x AS x1, a.y AS y1, {_DP} AS d FROM f a JOIN f b ON a.g = b.g AND a.id < b.id), pt AS (SELECT a.g, a.z AS z1, a.x AS x1, a.y AS y1, b.z AS z2, b.x AS x2, b.y AS y2, {_DP} AS d FROM t a JOIN t b ON a.g = b.g AND a.id < b.id),
v AS (SELECT a.g, {_VOTE.format(1)} FROM pf a JOIN pt b ON a.g = b.g AND abs(a.d - b.d) < 0.05 UNION ALL SELECT a.g, {_VOTE.format(2)} FROM pf a JOIN pt b ON a.g = b.g AND abs(a.d - b.d) < 0.05),
m AS (SELECT g, {", ".join(f"min({c}) AS {c}l, max({c}) AS {c}h" for c in "zxy")} FROM v GROUP BY 1), w AS (SELECT *, {", ".join(f"floor(({c}h - {c}l) / 0.1) + 1 AS {c}n" for c in "zxy")} FROM m),
k AS (SELECT v.g, {", ".join(f"coalesce(least(floor((v.{c} - {c}l) / nullif(({c}h - {c}l) / {c}n, 0)), {c}n - 1), 0) AS k{c}" for c in "zxy")}, {", ".join(f"any_value(({c}h - {c}l) / {c}n) AS s{c}, any_value({c}l) AS {c}l" for c in "zxy")}, count(*) AS votes FROM v JOIN w USING (g) GROUP BY 1, 2, 3, 4),
b AS (SELECT g, votes, zl + kz * sz AS zg, xl + kx * sx AS xg, yl + ky * sy AS yg FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY votes DESC, kz, kx, ky) AS r FROM k) WHERE r = 1),
n AS (SELECT f.g, f.id, b.votes, t.z - f.z AS z, t.x - f.x AS x, t.y - f.y AS y, sqrt(pow(t.z + zg - f.z, 2) + pow(t.x + xg - f.x, 2) + pow(t.y + yg - f.y, 2)) AS d, t.id AS tid FROM f JOIN t USING (g) JOIN b USING (g)),
o AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d, tid) AS r FROM n WHERE d < 0.2) SELECT g AS "group", max(votes) AS votes, count(*) AS matched, round(median(z), 6) AS z, round(median(x), 6) AS x, round(median(y), 6) AS y FROM o WHERE r = 1 GROUP BY 1""")
def translation_vote(spark, sf):
    """Even loci are the fixed points, odd ones the targets, of each (trace, label)."""
    p = points(spark, sf).select((F.col("trace") * 10 + F.col("label")).alias("group"), F.col("locus").alias("id"), *_XYZ).dropna()
    return spots.translation_vote(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), ["group"], _XYZ, 0.05, 0.1).select("group", "votes", "matched", *r6(*_XYZ))


@query(f"""WITH {D}, h AS (SELECT least(cls_i, cls_j) || greatest(cls_i, cls_j) AS class, (j - i) // 20 AS bin, count_if(dist < 0.2) AS called, count(dist) AS n FROM d GROUP BY 1, 2) SELECT class, bin, called, n, round(called / nullif(n, 0), 6) AS ratio FROM h""")
def class_histogram(spark, sf):
    cls = F.concat(F.least("cls_i", "cls_j"), F.greatest("cls_i", "cls_j"))
    h = _pairs(spark, sf).groupBy(cls.alias("class"), F.floor((F.col("j") - F.col("i")) / 20).alias("bin")).agg(F.count_if(F.col("dist") < 0.2).alias("called"), F.count("dist").alias("n"))
    return h.withColumn("ratio", F.round(F.try_divide(F.col("called").cast("double"), F.col("n")), 6))


@query()
def cluster_compartments(spark, sf):
    return spots.clusters(points(spark, sf), 0.3)


@query()
def decode_em(spark, sf):
    return spots.decode_by_em(_candidates(spark, sf).withColumn("spread", F.abs("z")).drop("score"), 3)


@query()
def decode_em_centres(spark, sf):
    """The centres of classes A and B are the first guesses of both copies."""
    p = points(spark, sf).dropna(subset=_XYZ)
    centres = p.groupBy("trace", F.col("cls").alias("side")).agg(*[F.median(c).alias(c) for c in _XYZ])
    return spots.decode_with_centres(_candidates(spark, sf).withColumn("spread", F.abs("z")).drop("score"), centres, 3).select("trace", "locus", "side", "candidate")
