"""Queries of boundary and domain callers; same conventions as the catalog, which they join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import boundaries
from quillspan.plans.catalog import D, _pairs, points, query, r6

_MAP = D + """, h AS (SELECT i, j, median(dist) AS v FROM d WHERE i < j GROUP BY 1, 2), m AS (SELECT i, j, v FROM h UNION ALL SELECT j, i, v FROM h), z AS (SELECT max(i) + 1 AS n FROM m)"""


def _population(spark, sf) -> DataFrame:
    """The map of median distances over all traces, both ways, as one map."""
    half = boundaries.population_map(_pairs(spark, sf)).select(F.lit(0).cast("long").alias("trace"), "i", "j", "value")
    return boundaries.mirrored(half)


_BANDS = _MAP + """, l AS (SELECT unnest(range(n)) AS c, n FROM z), f AS (SELECT i AS c, sum(v) AS s, count(v) AS k FROM m WHERE j - i BETWEEN 1 AND 5 GROUP BY 1), b AS (SELECT i AS c, sum(v) AS s, count(v) AS k FROM m WHERE i - j BETWEEN 1 AND 5 GROUP BY 1),
w AS (SELECT c, CASE WHEN c >= 5 AND c + 9 < n THEN (SELECT sum(s) / sum(k) FROM f WHERE f.c BETWEEN l.c - 5 AND l.c - 1) / (SELECT sum(s) / sum(k) FROM f WHERE f.c BETWEEN l.c AND l.c + 4) END AS fw,
  CASE WHEN c >= 10 AND c + 4 < n THEN (SELECT sum(s) / sum(k) FROM b WHERE b.c BETWEEN l.c AND l.c + 4) / (SELECT sum(s) / sum(k) FROM b WHERE b.c BETWEEN l.c - 5 AND l.c - 1) END AS bw FROM l),
r AS (SELECT c, coalesce(greatest(fw, bw), fw, bw) AS ratio FROM w WHERE fw IS NOT NULL OR bw IS NOT NULL)"""


@query(f"WITH {_BANDS} SELECT c, round(ratio, 6) AS ratio FROM r")
def band_ratios(spark, sf):
    return boundaries.band_ratios(_population(spark, sf)).select("c", *r6("ratio"))


@query(f"WITH {_BANDS} SELECT c, round(ratio, 6) AS ratio FROM r WHERE ratio > 1 AND ratio = (SELECT max(ratio) FROM r o WHERE o.c BETWEEN r.c - 5 AND r.c + 4)")
def valley_boundaries(spark, sf):
    return boundaries.valley_maxima(boundaries.band_ratios(_population(spark, sf))).select("c", *r6("ratio"))


_ARROW = _MAP + """, u AS (SELECT a.i, a.j, (b.v - a.v) / nullif(b.v + a.v, 0) AS v FROM m a LEFT JOIN m b ON b.i = a.i AND b.j = 2 * a.i - a.j WHERE a.j > a.i),
arrow AS (SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u UNION ALL SELECT unnest(range(n)), unnest(range(n)), 0.0 FROM z)"""


@query(f"WITH {_ARROW} SELECT i, j, round(v, 6) AS value FROM arrow")
def arrow_map(spark, sf):
    return boundaries.arrowhead(_population(spark, sf)).select("i", "j", *r6("value"))


@query(f"WITH {_MAP} SELECT c AS id, coalesce(round(sum(v), 6), 0) AS total, count(v)::DOUBLE AS known FROM (SELECT unnest(range(10, n - 9)) AS c FROM z) LEFT JOIN m ON i BETWEEN c - 10 AND c - 1 AND j BETWEEN c AND c + 9 GROUP BY 1")
def map_windows(spark, sf):
    """The square of ten loci before and ten loci from each place on."""
    map_ = _population(spark, sf)
    c = map_.groupBy("trace").agg(F.max("i").alias("n")).select("trace", F.explode(F.sequence(F.lit(10).cast("long"), F.col("n") - 9)).alias("id"))
    windows = c.select("trace", "id", (F.col("id") - 10).alias("r0"), F.col("id").alias("r1"), F.col("id").alias("c0"), (F.col("id") + 10).alias("c1"))
    return boundaries.window_sums(boundaries.prefix_sums(map_), windows).select("id", *r6("total"), "known")


@query(f"""WITH {_ARROW}, p0 AS (SELECT i, j, n FROM (SELECT unnest(range(1, n)) AS i, n FROM z), LATERAL (SELECT unnest(range(i + 1, n)) AS j)),
p AS (SELECT * FROM (SELECT i, j, CASE WHEN i >= j - i AND j + 2 * (j - i) <= n THEN j - i ELSE least(i, (n - j) // 2) END AS c FROM p0) WHERE c >= 1),
q AS (SELECT i, j, c, unnest(range(2 * c)) AS q FROM p),
t AS (SELECT q.i, q.j, a.v, 1 AS side FROM q JOIN arrow a ON a.j = q.j - 2 * c + q AND a.i >= q.i - c AND a.i < q.i - c + (q + 1) // 2 UNION ALL SELECT q.i, q.j, a.v, -1 FROM q JOIN arrow a ON a.j = q.j + q AND a.i >= q.i + (q + 1) // 2 AND a.i < q.i + c)
SELECT p.i, p.j, coalesce(sum(side * sign(v)), 0)::BIGINT AS sign, coalesce(round(sum(side * v), 6), 0) + 0 AS sum, round(var_pop(v), 6) AS var FROM p LEFT JOIN t ON t.i = p.i AND t.j = p.j GROUP BY 1, 2""")
def arrow_features(spark, sf):
    f = boundaries.triangle_features(boundaries.arrowhead(_population(spark, sf)))
    return f.select("i", "j", "sign", (F.round("sum", 6) + 0.0).alias("sum"), *r6("var"))


@query()
def arrow_boundaries(spark, sf):
    map_ = _population(spark, sf)
    loci = map_.select("trace", F.col("i").alias("locus")).distinct()
    return boundaries.arrow_boundaries(boundaries.triangle_features(boundaries.arrowhead(map_)), loci)


@query()
def domain_iterative(spark, sf):
    """Domains of each trace over the map of all traces, with smaller bounds when split."""
    normal = boundaries.population_map(_pairs(spark, sf))
    return boundaries.iterative_domains(points(spark, sf), 5, normal, rounds=10, scale_correlation=0.8, scale_distance=0.9, most_distance=0.2, most_correlation=0.02)


@query()
def domain_local(spark, sf):
    return boundaries.local_domains(points(spark, sf), 5, 0.25, context=40, most=0.5)
