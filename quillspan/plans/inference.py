"""Queries of ranks, tests and controls; same conventions as the catalog, which they join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import significance
from quillspan.plans.catalog import P, points, query, r6, table


@query("SELECT o_orderpriority, round(o_totalprice, 2) AS o_totalprice, any_value(n) AS n, any_value(r) AS rank FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (n - 1) / 2 AS r FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) AS n FROM orders)) GROUP BY 1, 2")
def mid_ranks(spark, sf):
    return significance.mid_ranks(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"), "n", "rank")


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle, round(quantile_cont(l_extendedprice, 0.95), 4) AS high FROM lineitem GROUP BY 1, 2")
def price_quantiles(spark, sf):
    q = significance.group_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"low": 0.05, "middle": 0.5, "high": 0.95})
    return q.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")])


_U = """c AS (SELECT event_type, value, count_if(user_id % 3 = 0) AS a, count_if(user_id % 3 <> 0) AS b FROM events WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY value) - b / 2 AS below FROM c),
u AS (SELECT event_type, sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, sum(a * below) AS u, sum(pow(a + b, 3) - (a + b)) AS t FROM r GROUP BY 1)"""


@query(f"WITH {_U} SELECT event_type, n1, n2, round(u, 1) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u")
def rank_sum(spark, sf):
    return significance.rank_sum(table(spark, sf, "events"), ["event_type"], "value", F.col("user_id") % 3 == 0).select("event_type", "n1", "n2", F.round("u", 1).alias("u"), *r6("z"))


_W = """d AS (SELECT l_shipmode AS mode, l_quantity - 100 * l_discount * 5 AS d FROM lineitem), c AS (SELECT mode, abs(d) AS a, count_if(d > 0) AS p, count_if(d < 0) AS m FROM d WHERE d <> 0 GROUP BY 1, 2),
r AS (SELECT *, sum(p + m) OVER (PARTITION BY mode ORDER BY a) - (p + m - 1) / 2 AS r FROM c), s AS (SELECT mode, sum(p + m)::BIGINT AS n, least(sum(p * r), sum(m * r)) AS w, sum(pow(p + m, 3) - (p + m)) AS t FROM r GROUP BY 1)"""


@query(f"WITH {_W.replace('l_quantity - 100 * l_discount * 5', 'round(l_quantity - 100 * l_discount * 5, 3)')} SELECT mode, n, round(w, 1) AS statistic, round((w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24), 6) AS z FROM s".replace("l_shipmode", "l_returnflag"))
def signed_rank(spark, sf):
    """Quantities against a multiple of the discount, by return flag."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.round(F.col("l_quantity") - 100 * F.col("l_discount") * 5, 3).alias("x"), F.lit(0.0).alias("y"))
    return significance.signed_rank(rows, ["mode"], "x", "y").select("mode", "n", F.round("statistic", 1).alias("statistic"), *r6("z"))


@query()
def p_values(spark, sf):
    """The p-values of the four tests of purchase values by user."""
    e, first = table(spark, sf, "events"), F.col("user_id") % 3 == 0
    u = significance.rank_sum(e, ["event_type"], "value", first).select("event_type", F.col("p").alias("p_rank_sum"))
    k = significance.ks_test(e, ["event_type"], "value", first).select("event_type", "ks", F.col("p").alias("p_ks"))
    t = significance.t_test(e, ["event_type"], "value", first).select("event_type", "t", F.col("p").alias("p_t"))
    return u.join(k, "event_type").join(t, "event_type")


@query(f"""WITH {P}, g AS (SELECT * FROM pts WHERE z IS NOT NULL), l AS (SELECT DISTINCT trace, cls FROM g) SELECT a.trace, a.locus, l.cls AS "group", round(sum(CASE WHEN b.cls = l.cls AND sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) > 0.001 THEN exp(-((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 0.02) ELSE 0 END), 6) AS density
FROM g a JOIN l ON l.trace = a.trace JOIN g b ON b.trace = a.trace GROUP BY 1, 2, 3""")
def control_densities(spark, sf):
    """The true labels' side of the controls."""
    return significance.density_controls(points(spark, sf), "cls", 0.1, 20).select("trace", "locus", "group", *r6("density"))


@query()
def density_controls(spark, sf):
    return significance.density_controls(points(spark, sf), "cls", 0.1, 100)


@query()
def trans_density_controls(spark, sf):
    """Chromosomes are runs of 20 loci, their two copies the even and the odd loci."""
    p = points(spark, sf).withColumn("chr", F.floor(F.col("locus") / 20)).withColumn("copy", F.col("locus") % 2)
    return significance.density_controls(p, "cls", 0.1, 100, apart=["chr", "copy"])


@query()
def mixing_controls(spark, sf):
    return significance.mixing_controls(points(spark, sf), "cls", 0.1, 200)
