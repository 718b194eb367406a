"""The reference operators' queries over the driver tables, with their DuckDB SQL.

``embeddings`` stand for points: trace = vec_id div 100, locus = vec_id % 100, the first three numbers are z, x, y, every eleventh
vector is undetected (null), and labels below 5 are class A.  ``events`` by user in order of time are ordered series.  Numbers
are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import columns as C
from quillspan.operators import aggregates, codes, decode, density, joins, ordered, pairs, segments, sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt to all of them for work that is long for each row; a large scan is left
    as it is.  (Not for frames with a shuffle: counting their partitions would run it.)"""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("vec_id") % 11 != 0
    axis = lambda i, n: F.when(seen, F.col("embedding")[i].cast("double")).alias(n)
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("trace"), (F.col("vec_id") % 100).alias("locus"), axis(0, "z"), axis(1, "x"), axis(2, "y"), F.when(F.col("label") < 5, "A").otherwise("B").alias("cls"), F.col("label").cast("long").alias("label"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id as trace, place in time as locus."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), n.alias("locus"), "event_id", "event_type", "value", (F.col("event_type") == "purchase").alias("on"))


P = """pts AS (SELECT vec_id // 100 AS trace, vec_id % 100 AS locus, CASE WHEN vec_id % 11 <> 0 THEN embedding[1]::DOUBLE END AS z,
CASE WHEN vec_id % 11 <> 0 THEN embedding[2]::DOUBLE END AS x, CASE WHEN vec_id % 11 <> 0 THEN embedding[3]::DOUBLE END AS y,
CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS cls, label::BIGINT AS label FROM embeddings)"""
D = P + """, d AS (SELECT a.trace, a.locus AS i, b.locus AS j, sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist,
a.cls AS cls_i, b.cls AS cls_j, a.label AS label_i, b.label AS label_j FROM pts a JOIN pts b ON a.trace = b.trace AND a.locus < b.locus)"""
S = """s AS (SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS locus, event_id, event_type, value,
event_type = 'purchase' AS "on" FROM events)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_distances(points(spark, sf_dir), ["cls", "label"])


# --- sources and projections


@query(f"WITH {P} SELECT trace, locus, round(z,6) AS z, round(x,6) AS x, round(y,6) AS y, cls FROM pts")
def scan_points(spark, sf):
    return points(spark, sf).select("trace", "locus", *r6("z", "x", "y"), "cls")


@query(f"WITH {P} SELECT trace, locus, round(z*200,6) AS z, round(x*107,6) AS x, round(y*107,6) AS y FROM pts WHERE z IS NOT NULL")
def unit_scale(spark, sf):
    p = points(spark, sf).filter("z is not null")
    return p.select("trace", "locus", *[F.round(F.col(c) * s, 6).alias(c) for c, s in (("z", 200), ("x", 107), ("y", 107))])


@query("""SELECT p_partkey, regexp_extract(c, '^([^:]+):([0-9]+)-([0-9]+)$', 1) AS chr, regexp_extract(c, '^([^:]+):([0-9]+)-([0-9]+)$', 2)::BIGINT AS "start",
regexp_extract(c, '^([^:]+):([0-9]+)-([0-9]+)$', 3)::BIGINT AS "end", (regexp_extract(c, '^([^:]+):([0-9]+)-([0-9]+)$', 2)::BIGINT + regexp_extract(c, '^([^:]+):([0-9]+)-([0-9]+)$', 3)::BIGINT) / 2 AS mid
FROM (SELECT p_partkey, 'chr' || (p_partkey % 23) || ':' || (p_partkey*1000) || '-' || (p_partkey*1000 + p_size) AS c FROM part)""")
def coord_parse(spark, sf):
    text = F.concat(F.lit("chr"), F.col("p_partkey") % 23, F.lit(":"), F.col("p_partkey") * 1000, F.lit("-"), F.col("p_partkey") * 1000 + F.col("p_size"))
    chrom, start, end, mid = C.coordinate(F.col("c"))
    return table(spark, sf, "part").select("p_partkey", text.alias("c")).select("p_partkey", chrom.alias("chr"), start.alias("start"), end.alias("end"), mid.alias("mid"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN contains(event_type, 'c') THEN 1 ELSE 0 END AS flag FROM events")
def flag_derive(spark, sf):
    state = F.when(F.col("event_type") == "error", "nan").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", C.is_on(state, "c").alias("flag"))


# --- pairs and maps


@query(f"WITH {D} SELECT trace, i, j, round(dist, 6) AS dist FROM d")
def pair_distance(spark, sf):
    return _pairs(spark, sf).select("trace", "i", "j", *r6("dist"))


@query(f"WITH {D} SELECT i, j, round(median(dist), 6) AS median_dist FROM d GROUP BY i, j")
def median_map(spark, sf):
    return pairs.median_map(_pairs(spark, sf)).select("i", "j", *r6("median_dist"))


@query(f"WITH {D} SELECT i, j, round(avg(dist), 6) AS mean_dist, count(dist) AS n FROM d GROUP BY i, j")
def mean_map(spark, sf):
    return pairs.mean_map(_pairs(spark, sf)).select("i", "j", *r6("mean_dist"), "n")


@query(f"""WITH {D} SELECT i, j, round(count_if(dist < 0.1) / nullif(count(dist), 0), 6) AS p_0, round(count_if(dist < 0.2) / nullif(count(dist), 0), 6) AS p_1,
round(count_if(dist < 0.4) / nullif(count(dist), 0), 6) AS p_2, count(dist) AS n FROM d GROUP BY i, j""")
def contact_map_multi(spark, sf):
    return pairs.contact_map(_pairs(spark, sf), [0.1, 0.2, 0.4]).select("i", "j", *r6("p_0", "p_1", "p_2"), "n")


@query(f"WITH {D} SELECT i, j, round(count_if(dist < 0.2) / nullif(count_if(dist < 0.2) + count_if(dist > 0.2), 0), 6) AS p FROM d GROUP BY i, j")
def contact_map_ties(spark, sf):
    return pairs.contact_map_without_ties(_pairs(spark, sf), 0.2).select("i", "j", *r6("p"))


@query(f"WITH {P} SELECT trace, round(avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END), 6) AS failure FROM pts GROUP BY trace")
def failure_rate(spark, sf):
    return pairs.failure_rate(points(spark, sf), "trace").select("trace", *r6("failure"))


@query(f"WITH {P}, f AS (SELECT locus FROM pts GROUP BY locus HAVING avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1) SELECT locus AS trace, trace AS locus, round(z, 6) AS z FROM pts WHERE locus IN (SELECT locus FROM f)")
def coverage_filter(spark, sf):
    p = points(spark, sf).select(F.col("locus").alias("trace"), F.col("trace").alias("locus"), "z")
    return pairs.covered(p, 0.1).select("trace", "locus", *r6("z"))


@query(f"""WITH {D} SELECT least(cls_i, cls_j) || greatest(cls_i, cls_j) AS class, (j - i) // 10 AS bin, count(dist) AS n, round(count_if(dist < 0.2) / nullif(count(dist), 0), 6) AS p FROM d GROUP BY 1, 2""")
def decay_by_class(spark, sf):
    return pairs.decay_by_class(_pairs(spark, sf), F.col("cls_i"), F.col("cls_j"), 10, 0.2).select("class", "bin", "n", *r6("p"))


@query(f"""WITH {D}, l AS (SELECT *, CASE WHEN dist > 0 THEN ln(dist) END AS ld FROM d) SELECT trace, i, j, round(ld - median(ld) OVER (PARTITION BY label_i, label_j), 6) AS centered FROM l""")
def block_center(spark, sf):
    return pairs.block_centered(_pairs(spark, sf), ["label_i", "label_j"]).select("trace", "i", "j", *r6("centered"))


@query(f"""WITH {D} SELECT trace, i, j, round(dist, 6) AS dist FROM d WHERE NOT (label_i % 3 = label_j % 3 AND i % 2 = j % 2)""")
def cis_exclusion(spark, sf):
    p = _pairs(spark, sf).withColumns({"chr_i": F.col("label_i") % 3, "chr_j": F.col("label_j") % 3, "homolog_i": F.col("i") % 2, "homolog_j": F.col("j") % 2})
    return pairs.without_cis(p).select("trace", "i", "j", *r6("dist"))


@query("SELECT least(floor(o_totalprice / 25000), 19)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")
def hist_bins(spark, sf):
    return pairs.histogram(table(spark, sf, "orders"), "o_totalprice", 0.0, 500000.0, 20)


@query(f"""WITH {D}, o AS (SELECT label_i AS bin_i, label_j AS bin_j FROM d WHERE dist < 0.3 UNION ALL SELECT label_j, label_i FROM d WHERE dist < 0.3) SELECT bin_i, bin_j, count(*) AS n FROM o GROUP BY 1, 2""")
def hist2d_symmetric(spark, sf):
    return pairs.histogram_2d(_pairs(spark, sf).filter("dist < 0.3"), F.col("label_i"), F.col("label_j"))


@query("""WITH v AS (SELECT user_id % 12 AS u, event_type || (hour(ts) % 8) AS c, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.u AS i, b.u AS j, round(corr(a.v, b.v), 6) AS r FROM v a JOIN v b ON a.c = b.c AND a.u < b.u GROUP BY 1, 2""")
def corr_matrix(spark, sf):
    v = table(spark, sf, "events").groupBy((F.col("user_id") % 12).alias("u"), F.concat("event_type", F.hour("ts") % 8).alias("c")).agg(F.avg("value").alias("v"))
    return pairs.correlation_matrix(v, "u", "c", "v").select("i", "j", *r6("r"))


# --- aggregates


@query("SELECT o_orderpriority, round(count_if(o_totalprice < 100000) / nullif(count(o_totalprice), 0), 6) AS rate, round(median(o_totalprice), 6) AS median_value FROM orders GROUP BY 1")
def assoc_rate(spark, sf):
    return aggregates.association_rate(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 100000).select("o_orderpriority", *r6("rate", "median_value"))


_E, _G = "(l_returnflag = 'R')", "(l_quantity < 20)"


@query(f"""SELECT l_suppkey, round(avg(CASE WHEN {_G} THEN {_E}::INT END), 6) AS event_given, round(avg(CASE WHEN NOT {_G} THEN {_E}::INT END), 6) AS event_not_given,
round(avg(CASE WHEN {_E} THEN {_G}::INT END), 6) AS given_event, round(avg(CASE WHEN NOT {_E} THEN {_G}::INT END), 6) AS given_not_event FROM lineitem GROUP BY 1""")
def cond_rate(spark, sf):
    out = aggregates.conditional_rates(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", F.col("l_quantity") < 20)
    return out.select("l_suppkey", *r6("event_given", "event_not_given", "given_event", "given_not_event"))


@query("SELECT user_id, round(avg((event_type = 'purchase')::INT), 6) AS frequency, count(*) AS n FROM events GROUP BY 1")
def burst_freq(spark, sf):
    return aggregates.frequency(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "purchase").select("user_id", *r6("frequency"), "n")


@query(f"""WITH {S}, m AS (SELECT trace, median(CASE WHEN "on" THEN value END) AS a, median(CASE WHEN NOT "on" THEN value END) AS b FROM s GROUP BY 1)
SELECT trace, round(a, 6) AS on_median, round(b, 6) AS off_median, round(CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END, 6) AS log2_ratio FROM m""")
def onoff_ratio(spark, sf):
    return aggregates.on_off_ratio(series(spark, sf), ["trace"], F.col("on"), "value").select("trace", *r6("on_median", "off_median", "log2_ratio"))


@query(f"""WITH {S}, q AS (SELECT trace, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY 1),
m AS (SELECT s.trace, avg(CASE WHEN value > q3 THEN "on"::INT END) AS a, avg(CASE WHEN value < q1 THEN "on"::INT END) AS b FROM s JOIN q ON s.trace = q.trace GROUP BY 1)
SELECT trace, round(a, 6) AS top, round(b, 6) AS bottom, round(a / nullif(b, 0), 6) AS ratio FROM m""")
def quartile_ratio_pct(spark, sf):
    return aggregates.quartile_ratio(series(spark, sf), ["trace"], "value", F.col("on")).select("trace", *r6("top", "bottom", "ratio"))


@query(f"""WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY trace) AS n FROM s),
m AS (SELECT trace, avg(CASE WHEN r > n - n // 4 THEN "on"::INT END) AS a, avg(CASE WHEN r <= n // 4 THEN "on"::INT END) AS b FROM k GROUP BY 1)
SELECT trace, round(a, 6) AS top, round(b, 6) AS bottom, round(a / nullif(b, 0), 6) AS ratio FROM m""")
def quartile_ratio_rank(spark, sf):
    return aggregates.quartile_ratio_by_rank(series(spark, sf), ["trace"], "value", "event_id", F.col("on")).select("trace", *r6("top", "bottom", "ratio"))


@query(f"""WITH {S}, t AS (SELECT 'early' AS stratum, * FROM s WHERE locus <= 20 UNION ALL SELECT 'late', * FROM s WHERE locus > 20 UNION ALL SELECT 'even', * FROM s WHERE trace % 2 = 0
UNION ALL SELECT 'odd', * FROM s WHERE trace % 2 = 1), m AS (SELECT stratum, median(CASE WHEN "on" THEN value END) AS a, median(CASE WHEN NOT "on" THEN value END) AS b FROM t GROUP BY 1)
SELECT stratum, round(a, 6) AS on_median, round(b, 6) AS off_median, round(CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END, 6) AS log2_ratio FROM m""")
def strata_ratio(spark, sf):
    strata = {"early": F.col("locus") <= 20, "late": F.col("locus") > 20, "even": F.col("trace") % 2 == 0, "odd": F.col("trace") % 2 == 1}
    return aggregates.strata_ratio(series(spark, sf), strata, F.col("on"), "value").select("stratum", *r6("on_median", "off_median", "log2_ratio"))


@query("""SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""")
def loglog_ols(spark, sf):
    return aggregates.log_log_fit(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", *r6("slope", "intercept"))


@query("""WITH r AS (SELECT l_partkey % 10 AS g, l_partkey, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS a, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS b FROM lineitem GROUP BY 1, 2)
SELECT g, round(sum(a*b)/nullif(sum(a*a), 0), 6) AS slope, round(sum(a*b)/nullif(sqrt(sum(a*a)*sum(b*b)), 0), 6) AS r FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def origin_slope(spark, sf):
    half = lambda k: F.avg(F.when(F.col("l_linenumber") % 2 == k, F.col("l_quantity")))
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 10).alias("g"), "l_partkey").agg(half(0).alias("a"), half(1).alias("b")).dropna()
    return aggregates.origin_fit(rows, ["g"], "a", "b").select("g", *r6("slope", "r"))


@query("SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, sf):
    return aggregates.pearson(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", *r6("r"))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer GROUP BY 1)
SELECT c_custkey, round(least(greatest(c_acctbal, a), b), 6) AS clipped FROM customer JOIN q USING (c_mktsegment)""")
def winsorize(spark, sf):
    return aggregates.winsorized(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", *r6("clipped"))


@query("SELECT c_nationkey, c_custkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def topk_group(spark, sf):
    return aggregates.top_k(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) AS cdf FROM orders")
def ecdf(spark, sf):
    return aggregates.empirical_cdf(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", *r6("cdf"))


_CDF = """{0} AS (SELECT v, {2} AS p FROM (SELECT v, sum(k) OVER (ORDER BY v) / sum(k) OVER () AS p FROM (SELECT {1} AS v, count_if(l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)))"""


@query(f"""WITH {_CDF.format("a", "l_extendedprice", "p")}, {_CDF.format("b", "l_quantity", "1 - p")} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CASE WHEN a.p > 0 THEN ln(a.p) END + 0.5 * CASE WHEN b.p > 0 THEN ln(b.p) END) / 1.5, 6) AS score
FROM lineitem JOIN a ON a.v = l_extendedprice JOIN b ON b.v = l_quantity""")
def logcdf_score(spark, sf):
    """Brighter is better, wider is worse; the pool are the returned items."""
    rows = table(spark, sf, "lineitem")
    out = aggregates.log_cdf_score(rows, rows.filter("l_returnflag = 'R'"), {"l_extendedprice": (1.0, True), "l_quantity": (0.5, False)})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6("score"))


@query(f"""WITH {S}, c AS (SELECT event_id % 7 AS g, value, count_if("on") AS a, count_if(NOT "on") AS b FROM s GROUP BY 1, 2),
d AS (SELECT g, value, sum(a) OVER w / sum(a) OVER (PARTITION BY g) - sum(b) OVER w / sum(b) OVER (PARTITION BY g) AS d FROM c WINDOW w AS (PARTITION BY g ORDER BY value)),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(d) DESC, value) AS r FROM d) SELECT g, round(d, 6) AS ks FROM k WHERE r = 1""")
def ks_stat(spark, sf):
    s = series(spark, sf).withColumn("g", F.col("event_id") % 7)
    return aggregates.ks_statistic(s, ["g"], "value", F.col("on")).select("g", *r6("ks"))


@query(f"""WITH {S}, c AS (SELECT event_id % 7 AS g, value, count_if("on") AS a, count_if(NOT "on") AS b FROM s GROUP BY 1, 2),
d AS (SELECT g, value, sum(a) OVER w / sum(a) OVER (PARTITION BY g) AS p, sum(b) OVER w / sum(b) OVER (PARTITION BY g) AS q FROM c WINDOW w AS (PARTITION BY g ORDER BY value))
SELECT g, round(min(value), 6) AS threshold FROM d WHERE p >= 1 - q GROUP BY 1""")
def best_threshold(spark, sf):
    s = series(spark, sf).withColumn("g", F.col("event_id") % 7)
    return aggregates.best_threshold(s, ["g"], "value", F.col("on")).select("g", *r6("threshold"))


# --- ordered


@query(f"""WITH {P}, n AS (SELECT *, lead(locus) OVER w AS l2, lead(z) OVER w AS z2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY trace ORDER BY locus))
SELECT trace, locus, round(CASE WHEN l2 = locus + 1 THEN sqrt((z-z2)*(z-z2)+(x-x2)*(x-x2)+(y-y2)*(y-y2)) END, 6) AS neighbor_dist FROM n""")
def neighbor_dist(spark, sf):
    return ordered.neighbor_distance(points(spark, sf)).select("trace", "locus", *r6("neighbor_dist"))


def _mean(c: str) -> str:
    return f"(sum({c}) OVER w - coalesce({c}, 0)) / nullif(count({c}) OVER w - CASE WHEN {c} IS NULL THEN 0 ELSE 1 END, 0)"


@query(f"""WITH {P}, m AS (SELECT *, {_mean('z')} AS mz, {_mean('x')} AS mx, {_mean('y')} AS my FROM pts WINDOW w AS (PARTITION BY trace ORDER BY locus RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT trace, locus, round(sqrt((z-mz)*(z-mz)+(x-mx)*(x-mx)+(y-my)*(y-my)), 6) AS local_dist FROM m""")
def local_dist(spark, sf):
    return ordered.local_distance(points(spark, sf), 3).select("trace", "locus", *r6("local_dist"))


_BA = "(avg({0}) OVER b - avg({0}) OVER a)*(avg({0}) OVER b - avg({0}) OVER a)"


@query(f"""WITH {P} SELECT trace, locus, round(sqrt({_BA.format('z')} + {_BA.format('x')} + {_BA.format('y')}), 6) AS shift FROM pts
WINDOW b AS (PARTITION BY trace ORDER BY locus ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY trace ORDER BY locus ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def centroid_shift(spark, sf):
    return ordered.centroid_shift(points(spark, sf), 5).select("trace", "locus", *r6("shift"))


_BAND = f"""WITH {D}, k AS (SELECT trace, i, j, dist, unnest(range(j - 3, i + 5)) AS c FROM d WHERE j - i < 8 AND dist IS NOT NULL),
e AS (SELECT trace, c, list(dist) FILTER (i < c AND j >= c) AS b, list(dist) FILTER (NOT (i < c AND j >= c) AND dist > 0) AS w FROM k GROUP BY 1, 2),
l AS (SELECT trace, locus AS c, max(locus) OVER (PARTITION BY trace) + 1 AS n FROM pts)"""


def _effect(m: str) -> str:
    mid = lambda v: f"list_aggregate({v}, '{m}')"
    spread = lambda v: mid(f"list_transform({v}, lambda x: pow(x - {mid(v)}, 2))")
    return f"({mid('b')} - {mid('w')}) / nullif(sqrt({spread('b')} + {spread('w')}), 0)"


_KS = """sign(list_aggregate(b, 'median') - list_aggregate(w, 'median')) * list_max(list_transform(list_distinct(list_concat(b, w)),
lambda t: abs(len(list_filter(b, lambda x: x <= t)) / len(b) - len(list_filter(w, lambda x: x <= t)) / len(w))))"""


def _sliding(score: str) -> str:
    return _BAND + f" SELECT l.trace, l.c, round(CASE WHEN l.c < 2 OR l.c + 2 >= n OR b IS NULL OR w IS NULL THEN 0 ELSE {score} END, 6) AS score FROM l LEFT JOIN e ON e.trace = l.trace AND e.c = l.c"


def _slide(spark, sf, metric: str) -> DataFrame:
    loci = points(spark, sf).select("trace", F.col("locus").alias("c"))
    return ordered.boundary_score(_pairs(spark, sf), loci, 4, metric).select("trace", "c", *r6("score"))


@query(_sliding(_effect("median")))
def slide_score_median(spark, sf):
    return _slide(spark, sf, "median")


@query(_sliding(_effect("avg")))
def slide_score_mean(spark, sf):
    return _slide(spark, sf, "mean")


@query(_sliding(_KS))
def slide_score_ks(spark, sf):
    return _slide(spark, sf, "ks")


@query(_sliding("list_avg(b) / nullif(list_avg(w), 0)"))
def slide_score_insulation(spark, sf):
    return _slide(spark, sf, "insulation")


@query(_sliding("(list_avg(w) - list_avg(b)) / nullif(list_avg(w) + list_avg(b), 0)"))
def slide_score_normed(spark, sf):
    return _slide(spark, sf, "normed_insulation")


@query(f"""WITH {S}, m AS (SELECT *, max(value) OVER (PARTITION BY trace ORDER BY locus ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m FROM s) SELECT trace, locus, round(value, 6) AS value FROM m WHERE value = m AND value > 10""")
def valley_max(spark, sf):
    return ordered.valley_maxima(series(spark, sf), "value", 3, 10.0).select("trace", "locus", *r6("value"))


@query(f"""WITH {S}, c AS (SELECT *, CASE WHEN lag("on") OVER w IS NOT DISTINCT FROM "on" AND locus > 1 THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY trace ORDER BY locus)),
r AS (SELECT *, sum(n) OVER (PARTITION BY trace ORDER BY locus) AS run FROM c) SELECT trace, run::BIGINT AS run, any_value("on") AS label, min(locus) AS "first", count(*) AS length FROM r GROUP BY 1, 2""")
def run_lengths(spark, sf):
    return ordered.runs(series(spark, sf), "trace", ["locus"], F.col("on")).select("trace", F.col("run").cast("long").alias("run"), "label", "first", "length")


@query(f"""WITH {P}, e AS (SELECT trace, locus, z, max(CASE WHEN z IS NOT NULL THEN locus END) OVER (PARTITION BY trace ORDER BY locus) AS p,
min(CASE WHEN z IS NOT NULL THEN locus END) OVER (PARTITION BY trace ORDER BY locus ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM pts)
SELECT e.trace, e.locus, round(coalesce(e.z, a.z + (b.z - a.z) * (e.locus - p) / nullif(n - p, 0), a.z, b.z), 6) AS filled FROM e LEFT JOIN pts a ON a.trace = e.trace AND a.locus = p LEFT JOIN pts b ON b.trace = e.trace AND b.locus = n""")
def gap_interp(spark, sf):
    return ordered.interpolated(points(spark, sf), "z").select("trace", "locus", *r6("filled"))


@query(f"""WITH {P}, n AS (SELECT *, sqrt((z-lead(z) OVER w)*(z-lead(z) OVER w)+(x-lead(x) OVER w)*(x-lead(x) OVER w)+(y-lead(y) OVER w)*(y-lead(y) OVER w)) AS a FROM pts WINDOW w AS (PARTITION BY trace ORDER BY locus))
SELECT trace, locus, coalesce(a >= 0.2 AND lag(a) OVER (PARTITION BY trace ORDER BY locus) >= 0.2, false) AS loop_out FROM n""")
def loopout(spark, sf):
    return ordered.loop_outs(points(spark, sf), 0.2).select("trace", "locus", "loop_out")


@query("WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT n_regionkey, (sum(n) OVER (ORDER BY n_regionkey) - n)::BIGINT AS begin, (sum(n) OVER (ORDER BY n_regionkey))::BIGINT AS stop FROM n")
def cumsum_edges(spark, sf):
    sizes = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return ordered.cumulative_edges(sizes, "n_regionkey", "n").select("n_regionkey", "begin", "stop")


@query(f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY locus) - 1 AS n, count(*) OVER (PARTITION BY trace) AS c FROM pts)
SELECT a.trace, a.locus, b.label AS shifted FROM r a JOIN r b ON a.trace = b.trace AND (a.n + 7) % a.c = b.n""")
def circular_shift(spark, sf):
    return ordered.shifted(points(spark, sf), 7).select("trace", "locus", "shifted")


# --- density


_G3 = "exp(-0.5 * ((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / (0.1*0.1))"


@query(f"""WITH {P} SELECT a.trace, a.locus, b.cls AS "group", round(sum({_G3}), 6) AS density FROM pts a JOIN pts b ON a.trace = b.trace AND a.z IS NOT NULL AND b.z IS NOT NULL
AND sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) > 0.001 GROUP BY 1, 2, 3""")
def density_score(spark, sf):
    return density.density_scores(points(spark, sf), "cls", 0.1).select("trace", "locus", "group", *r6("density"))


_TRANS = "a.trace = b.trace AND a.z IS NOT NULL AND b.z IS NOT NULL AND NOT (a.locus // 20 = b.locus // 20 AND a.locus % 2 = b.locus % 2)"


@query(f"""WITH {P} SELECT a.trace, a.locus, b.cls AS "group", round(sum({_G3}), 6) AS density FROM pts a JOIN pts b ON {_TRANS} GROUP BY 1, 2, 3""")
def trans_density(spark, sf):
    """Chromosomes are runs of 20 loci, their two copies the even and the odd loci."""
    p = points(spark, sf).withColumn("chr", F.floor(F.col("locus") / 20)).withColumn("copy", F.col("locus") % 2)
    return density.trans_density(p, "chr", "copy", "cls", 0.1).select("trace", "locus", "group", *r6("density"))


@query(f"""WITH {P}, r AS (SELECT trace, sqrt(var_pop(z) + var_pop(x) + var_pop(y)) AS rg FROM pts WHERE z IS NOT NULL GROUP BY 1) SELECT a.trace, a.locus, b.cls AS "group", round(sum({_G3.replace("(0.1*0.1)", "(0.01 * rg * rg / 0.25)")}), 6) AS density
FROM pts a JOIN pts b ON {_TRANS} JOIN r ON r.trace = a.trace GROUP BY 1, 2, 3""")
def trans_density_rescaled(spark, sf):
    p = points(spark, sf).withColumn("chr", F.floor(F.col("locus") / 20)).withColumn("copy", F.col("locus") % 2)
    return density.trans_density(p, "chr", "copy", "cls", 0.1, to=0.5).select("trace", "locus", "group", *r6("density"))


@query(f"WITH {P} SELECT trace, label, round(sqrt(var_pop(z) + var_pop(x) + var_pop(y)), 6) AS rg, count(*) AS n FROM pts WHERE z IS NOT NULL GROUP BY 1, 2")
def gyration(spark, sf):
    return density.gyration(points(spark, sf), ["trace", "label"]).select("trace", "label", *r6("rg"), "n")


@query(f"""WITH {P}, s AS (SELECT a.trace, a.locus, a.cls AS own, b.cls AS g, round(sum({_G3}), 9) AS v FROM pts a JOIN pts b ON a.trace = b.trace AND a.z IS NOT NULL AND b.z IS NOT NULL
AND sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) > 0.001 GROUP BY 1, 2, 3, 4), q AS (SELECT trace, g, quantile_cont(v, 0.33) AS q FROM s WHERE own = g GROUP BY 1, 2),
o AS (SELECT s.trace, s.g, avg((own = s.g)::INT) AS purity FROM s JOIN q ON s.trace = q.trace AND s.g = q.g WHERE v >= q GROUP BY 1, 2)
SELECT trace, g AS "group", round(purity, 6) AS purity, round(avg(purity) OVER (PARTITION BY trace), 6) AS score FROM o""")
def segregation(spark, sf):
    p = points(spark, sf)
    scores = density.density_scores(p, "cls", 0.1).withColumn("density", F.round("density", 9)).join(p.select("trace", "locus", F.col("cls").alias("own")), ["trace", "locus"])
    return density.segregation(scores, ["trace"], "own").select("trace", "group", *r6("purity", "score"))


@query(f"WITH {P} SELECT trace, locus // 10 AS segment, round(avg((cls = 'A')::INT), 6) AS purity FROM pts GROUP BY 1, 2")
def segment_purity(spark, sf):
    p = points(spark, sf).withColumn("segment", F.floor(F.col("locus") / 10))
    return segments.purity(p, ["trace", "segment"], F.col("cls") == "A").select("trace", "segment", *r6("purity"))


# --- joins


_AB = "FROM pts a JOIN pts b ON a.trace = b.trace AND a.locus % 2 = 0 AND b.locus % 2 = 1"
_DIST = "sqrt((a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


def _near(spark, sf, radius: float, **more) -> DataFrame:
    p = points(spark, sf)
    a, b = p.filter("locus % 2 = 0").withColumnRenamed("locus", "a"), p.filter("locus % 2 = 1").withColumnRenamed("locus", "b")
    return joins.radius_join(a, b, ["z", "x", "y"], radius, ["trace"], "a", "b", **more)


@query(f"WITH {P} SELECT a.trace, a.locus AS a, b.locus AS b, round({_DIST}, 6) AS dist {_AB} AND {_DIST} <= 0.15")
def radius_join(spark, sf):
    return _near(spark, sf, 0.15).select("trace", "a", "b", *r6("dist"))


@query(f"WITH {P} SELECT a.trace, a.locus AS a, b.locus AS b, round(greatest(abs(a.z-b.z), abs(a.x-b.x), abs(a.y-b.y)), 6) AS dist {_AB} AND greatest(abs(a.z-b.z), abs(a.x-b.x), abs(a.y-b.y)) < 0.1")
def box_join(spark, sf):
    return _near(spark, sf, 0.1, norm="box", strict=True).select("trace", "a", "b", *r6("dist"))


def _nearest(spark, sf, k: int) -> DataFrame:
    p = points(spark, sf)
    return joins.k_nearest(p.filter("locus % 2 = 0").withColumnRenamed("locus", "a"), p.filter("locus % 2 = 1").withColumnRenamed("locus", "b"), ["z", "x", "y"], ["trace"], "a", "b", k)


_RANKED = f"WITH {P}, n AS (SELECT a.trace, a.locus AS a, b.locus AS b, {_DIST} AS dist, row_number() OVER (PARTITION BY a.trace, a.locus ORDER BY {_DIST}, b.locus) AS r {_AB} AND a.z IS NOT NULL AND b.z IS NOT NULL)"


@query(_RANKED + " SELECT trace, a, round(avg(dist), 6) AS mean_dist, count(*) AS n FROM n WHERE r <= 10 GROUP BY 1, 2")
def knn_mean(spark, sf):
    return _nearest(spark, sf, 10).groupBy("trace", "a").agg(F.round(F.avg("dist"), 6).alias("mean_dist"), F.count("*").alias("n"))


@query(_RANKED + " SELECT trace, a, b, round(dist, 6) AS dist FROM n WHERE r = 1")
def nearest_one(spark, sf):
    return _nearest(spark, sf, 1).select("trace", "a", "b", *r6("dist"))


@query(f"WITH {P}, n AS (SELECT a.trace, a.locus AS a, b.locus AS b, {_DIST} AS dist {_AB} AND {_DIST} <= 0.1), c AS (SELECT *, count(*) OVER (PARTITION BY trace, a) AS na, count(*) OVER (PARTITION BY trace, b) AS nb FROM n) SELECT trace, a, b, round(dist, 6) AS dist FROM c WHERE na = 1 AND nb = 1")
def unique_pairs(spark, sf):
    return joins.mutually_unique(_near(spark, sf, 0.1), ["trace"], "a", "b").select("trace", "a", "b", *r6("dist"))


@query(f"WITH {P} SELECT trace, locus FROM pts p WHERE z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.trace = p.trace AND b.locus > p.locus AND sqrt((p.z-b.z)*(p.z-b.z)+(p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) <= 0.1)")
def remove_redundancy(spark, sf):
    p = points(spark, sf).filter("z is not null")
    close = joins.radius_join(p.withColumnRenamed("locus", "a"), p.withColumnRenamed("locus", "b"), ["z", "x", "y"], 0.1, ["trace"], "a", "b")
    return joins.without_redundant(close, p, ["trace"], "locus", "a", "b").select("trace", "locus")


@query(f"""WITH {P}, c AS (SELECT label, round(avg(z),9) AS z, round(avg(x),9) AS x, round(avg(y),9) AS y FROM pts GROUP BY 1), n AS (SELECT a.trace * 1000000 + a.locus AS id, b.label AS centre, {_DIST} AS dist,
row_number() OVER (PARTITION BY a.trace, a.locus ORDER BY {_DIST}, b.label) AS r FROM pts a CROSS JOIN c b WHERE a.z IS NOT NULL) SELECT id, centre, round(dist, 6) AS dist FROM n WHERE r = 1""")
def nearest_centroid(spark, sf):
    p = points(spark, sf).withColumn("id", F.col("trace") * 1000000 + F.col("locus"))
    centres = p.groupBy(F.col("label").alias("centre")).agg(*[F.round(F.avg(c), 9).alias(c) for c in "zxy"])
    return joins.nearest_centroid(p, centres, ["z", "x", "y"], "id", "centre").select("id", "centre", *r6("dist"))


_REG = "reg AS (SELECT p_partkey AS region, p_brand AS g, p_retailprice AS \"start\", p_retailprice + p_size AS \"end\" FROM part)"


def _regions(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("region"), F.col("p_brand").alias("g"), F.col("p_retailprice").alias("start"), (F.col("p_retailprice") + F.col("p_size")).alias("end"))


def _places(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (F.col("p_retailprice") + 3).alias("place"))


_PL = "pl AS (SELECT p_partkey AS id, p_brand AS g, p_retailprice + 3 AS place FROM part)"


def _matched(closed: str, order: str, r: str) -> str:
    return f"WITH {_REG}, {_PL}, m AS (SELECT id, region, row_number() OVER (PARTITION BY id ORDER BY region {order}) AS r FROM pl JOIN reg USING (g) WHERE place >= \"start\" AND place {closed} \"end\") SELECT id, region FROM m{r}"


@query(_matched("<=", "", " WHERE r = 1"))
def region_match_first(spark, sf):
    return joins.with_region(_places(spark, sf), _regions(spark, sf), "place", ["g"], "region", "both").groupBy("id").agg(F.min("region").alias("region"))


@query(_matched("<=", "DESC", " WHERE r = 1"))
def region_match_last(spark, sf):
    return joins.with_region(_places(spark, sf), _regions(spark, sf), "place", ["g"], "region", "both", last=True).groupBy("id").agg(F.max("region").alias("region"))


@query(_matched("<", "", ""))
def region_match_tss(spark, sf):
    return joins.matched_in_interval(_places(spark, sf), _regions(spark, sf), "place", ["g"], keep=["id"]).select("id", "region")


@query(f"""WITH {_REG}, q AS (SELECT p_partkey AS id, p_brand AS g, p_retailprice + 3 AS s, p_retailprice + 3 + p_size / 2.0 AS e FROM part),
h AS (SELECT region, sum((least(q.e, a."end") - greatest(q.s, a."start")) / nullif(q.e - q.s, 0)) AS n FROM reg a JOIN q USING (g) WHERE (s >= a."start" AND s < a."end") OR (e >= a."start" AND e < a."end") GROUP BY 1)
SELECT reg.region, round(coalesce(n, 0), 6) AS enhancers FROM reg LEFT JOIN h USING (region)""")
def interval_overlap_sum(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (F.col("p_retailprice") + 3).alias("s"), (F.col("p_retailprice") + 3 + F.col("p_size") / 2.0).alias("e"))
    return joins.overlapping_counts(_regions(spark, sf), q, "region", "id", ["g"], 64.0).select("region", F.round("n", 6).alias("enhancers"))


@query(f"WITH {_REG}, {_PL}, c AS (SELECT region, count(*) AS n FROM pl JOIN reg USING (g) WHERE place >= \"start\" AND place < \"end\" GROUP BY 1) SELECT region, coalesce(n, 0) AS n FROM reg LEFT JOIN c USING (region)")
def bed_count(spark, sf):
    return joins.points_in_regions(_places(spark, sf), _regions(spark, sf), "place", ["g"], "region")


# --- sequences: letters of the texts


_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _letters():
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))


def _kmer_sql(name: str, key: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT {key}, substring(s, i::INT, {k}) AS kmer FROM (SELECT {key}, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM (SELECT {key}, {_SEQ} AS s FROM {source})))"


@query(f"WITH {_kmer_sql('k', 'doc_id', 'documents', 5)} SELECT kmer, least(count(*), 65535)::BIGINT AS n FROM k GROUP BY 1")
def kmer_count(spark, sf):
    return sequences.kmer_counts(spread(table(spark, sf, "documents")), "doc_id", _letters(), 5)


@query(f"WITH {_kmer_sql('k', 'item_id', 'benchmark', 4)}, u AS (SELECT DISTINCT kmer FROM k) SELECT kmer, (64 * v(substr(kmer,1,1)) + 16 * v(substr(kmer,2,1)) + 4 * v(substr(kmer,3,1)) + v(substr(kmer,4,1)))::BIGINT AS code FROM u".replace("v(substr(kmer,1,1))", "(CASE substr(kmer,1,1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)").replace("v(substr(kmer,2,1))", "(CASE substr(kmer,2,1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)").replace("v(substr(kmer,3,1))", "(CASE substr(kmer,3,1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)").replace("v(substr(kmer,4,1))", "(CASE substr(kmer,4,1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)"))
def kmer_encode(spark, sf):
    return sequences.kmer_rows(table(spark, sf, "benchmark"), "item_id", _letters(), 4).select("kmer").distinct().select("kmer", C.kmer_code(F.col("kmer")).alias("code"))


@query(f"SELECT item_id, reverse(translate({_SEQ}, 'ACGT', 'TGCA')) AS revcomp FROM benchmark")
def revcomp(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", C.reverse_complement(_letters()).alias("revcomp"))


@query(f"SELECT doc_id, round((length({_SEQ}) - length(translate({_SEQ}, 'GC', ''))) / nullif(length({_SEQ}), 0), 6) AS gc FROM documents")
def gc_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(C.share_of(_letters()), 6).alias("gc"))


@query(f"WITH {_kmer_sql('k', 'doc_id', 'documents', 8)}, c AS (SELECT kmer, least(count(*), 65535) AS n FROM k GROUP BY 1), {_kmer_sql('q', 'item_id', 'benchmark', 8)} SELECT b.item_id, coalesce(sum(n), 0)::BIGINT AS hits FROM benchmark b LEFT JOIN q USING (item_id) LEFT JOIN c USING (kmer) GROUP BY 1")
def offtarget_sum(spark, sf):
    probes = table(spark, sf, "benchmark")
    counts = sequences.kmer_counts_of(spread(table(spark, sf, "documents")), "doc_id", _letters(), 8, codes.wanted(probes, _letters(), 8))
    return sequences.off_target_hits(probes, counts, "item_id", _letters(), 8)


@query(f"WITH {_kmer_sql('k', 'doc_id', 'documents', 14)}, c AS (SELECT kmer, least(count(*), 65535) AS n FROM k GROUP BY 1), {_kmer_sql('q', 'item_id', 'benchmark', 14)}, h AS (SELECT b.item_id, coalesce(sum(n), 0) AS hits FROM benchmark b LEFT JOIN q USING (item_id) LEFT JOIN c USING (kmer) GROUP BY 1) SELECT item_id FROM h WHERE hits <= 200")
def screen_anti(spark, sf):
    probes = table(spark, sf, "benchmark")
    counts = sequences.kmer_counts_of(spread(table(spark, sf, "documents")), "doc_id", _letters(), 14, codes.wanted(probes, _letters(), 14))
    return sequences.screened(probes, counts, "item_id", _letters(), 14, 200).select("item_id")


@query(f"""WITH {_kmer_sql('k', 'item_id', 'benchmark', 10)}, u AS (SELECT item_id AS i, kmer, count(*) AS times FROM k GROUP BY 1, 2),
t AS (SELECT item_id AS j, {_SEQ} AS s FROM benchmark), b AS (SELECT j, s, reverse(translate(s, 'ACGT', 'TGCA')) AS c FROM t),
n AS (SELECT i, j, times, (length(s) - length(replace(s, kmer, ''))) // 10 + (length(c) - length(replace(c, kmer, ''))) // 10 AS n FROM u JOIN b ON i > j AND (contains(s, kmer) OR contains(c, kmer)))
SELECT i, j, sum(times * n)::BIGINT AS shared FROM n GROUP BY 1, 2""")
def similarity_pairs(spark, sf):
    return sequences.similar_pairs(table(spark, sf, "benchmark"), "item_id", _letters(), 10)


@query("""WITH k AS (SELECT p_brand, p_partkey, p_retailprice, abs(p_retailprice - (min(p_retailprice) OVER (PARTITION BY p_brand) + max(p_retailprice) OVER (PARTITION BY p_brand)) / 2) AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_retailprice, p_partkey) AS r FROM (SELECT p_brand, p_partkey + p_retailprice / 1e6 AS q, p_partkey, p_retailprice, k FROM k)) SELECT p_brand, r AS pick, round(k, 6) AS distance FROM r WHERE r <= 4""")
def subset_mid(spark, sf):
    w = W.partitionBy("p_brand")
    mid = (F.min("p_retailprice").over(w) + F.max("p_retailprice").over(w)) / 2
    parts = table(spark, sf, "part").withColumn("distance", F.round(F.abs(F.col("p_retailprice") - mid), 6))
    return sequences.choose(parts, ["p_brand"], "p_retailprice", 4, "mid").select("p_brand", F.col("pick").cast("long").alias("pick"), "distance")


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_dedup(spark, sf):
    a, b = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return a.select(F.col("c_nationkey").alias("k")).unionByName(b.select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    a, b = table(spark, sf, "customer").filter("c_acctbal > 9900"), table(spark, sf, "supplier")
    return a.select(F.col("c_nationkey").alias("k")).intersect(b.select(F.col("s_nationkey").alias("k")))


_USED = "u AS (SELECT DISTINCT least(l_suppkey, l_partkey)::BIGINT AS a, greatest(l_suppkey, l_partkey)::BIGINT AS b FROM lineitem)"


@query(f"WITH {_USED} SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = x.s_suppkey AND u.b = y.s_suppkey)")
def blank_codes(spark, sf):
    """Suppliers are readouts; a pair is used where a line item has both numbers."""
    codes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"))
    used = table(spark, sf, "lineitem").select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b"))
    return sequences.unused_pairs(codes, used)


# --- segments


_SEG = D + ", e AS (SELECT trace, i // 10 AS a, j // 10 AS b, dist FROM d)"


def _segments(spark, sf) -> DataFrame:
    s = F.floor(F.col("locus") / 10)
    return points(spark, sf).groupBy("trace", s.alias("segment")).agg(F.min("locus").alias("first"), F.max("locus").alias("last"))


_DOMS = "WITH " + _SEG + """, i AS (SELECT trace, a, list(dist) AS w FROM e WHERE a = b AND dist IS NOT NULL GROUP BY 1, 2), o AS (SELECT trace, a, b, list(dist) AS l FROM e WHERE a < b AND dist IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT o.trace, o.a, o.b AS seg_b, l AS b, list_concat(coalesce(x.w, []), coalesce(y.w, [])) AS w FROM o LEFT JOIN i x ON x.trace = o.trace AND x.a = o.a LEFT JOIN i y ON y.trace = o.trace AND y.a = o.b)"""


def _domain_sql(score: str) -> str:
    return _DOMS + f" SELECT trace, a, seg_b AS b, round(CASE WHEN len(w) = 0 THEN 0 ELSE {score} END, 6) AS domain_dist FROM m"


def _domains(spark, sf, metric: str) -> DataFrame:
    found = segments.segment_point_pairs(points(spark, sf), _segments(spark, sf))
    return segments.domain_distances(found, metric).select("trace", "a", "b", *r6("domain_dist"))


@query(_domain_sql(_effect("median")))
def domain_distance(spark, sf):
    return _domains(spark, sf, "median")


@query(_domain_sql(_effect("avg")))
def domain_distance_mean(spark, sf):
    return _domains(spark, sf, "mean")


@query(_domain_sql(_KS))
def domain_distance_ks(spark, sf):
    return _domains(spark, sf, "ks")


@query(_domain_sql("list_aggregate(b, 'median') / nullif(list_aggregate(w, 'median'), 0)"))
def domain_distance_insulation(spark, sf):
    return _domains(spark, sf, "insulation")


@query(_domain_sql("list_aggregate(b, 'median') - list_aggregate(w, 'median')"))
def domain_distance_absolute(spark, sf):
    return _domains(spark, sf, "absolute_median")


@query(_DOMS + " SELECT trace, a, seg_b AS b FROM m WHERE list_aggregate(b, 'median') / nullif(list_aggregate(w, 'median'), 0) < 1")
def domain_contact_call(spark, sf):
    """Domains whose median distance between them is below that within them."""
    found = segments.segment_point_pairs(points(spark, sf), _segments(spark, sf))
    return segments.domain_distances(found, "insulation").filter("domain_dist < 1 and domain_dist > 0").select("trace", "a", "b")


@query(f"WITH {_SEG} SELECT a AS seg_i, b AS seg_j, round(count_if(dist <= 0.2) / nullif(count(dist), 0), 6) AS contact FROM e GROUP BY 1, 2")
def domain_contacts(spark, sf):
    found = segments.segment_point_pairs(points(spark, sf), _segments(spark, sf))
    return segments.domain_contacts(found, 0.2).select("seg_i", "seg_j", *r6("contact"))


# --- sequential operators: tested against plain versions


def _candidates(spark, sf) -> DataFrame:
    p = points(spark, sf).filter("z is not null")
    return p.select("trace", F.floor(F.col("locus") / 4).alias("locus"), (F.col("locus") % 4).alias("candidate"), "z", "x", "y", (F.col("label") / 10).alias("score"), F.col("label").cast("double").alias("brightness"))


@query()
def pick_dynamic(spark, sf):
    p = _candidates(spark, sf)
    steps = ordered.neighbor_distance(points(spark, sf), 4).select("trace", F.col("neighbor_dist").alias("dist")).dropna()
    return decode.best_chain(p, steps, 1.0)


@query()
def pick_em(spark, sf):
    return decode.pick_by_em(_candidates(spark, sf).drop("score"))[0]


@query()
def greedy_match(spark, sf):
    return decode.greedy_match(_near(spark, sf, 0.2), "trace")


@query()
def tile_nonoverlap(spark, sf):
    return decode.tile(table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("start")), "g", "start", 42, 2)


@query()
def domain_merge(spark, sf):
    return segments.merged_domains(points(spark, sf), 5)


@query()
def hull_bootstrap(spark, sf):
    return decode.inside_hull(points(spark, sf), "cls", 12, 4)


@query()
def pca1(spark, sf):
    return decode.first_component_of(points(spark, sf), ["z", "x", "y"])
