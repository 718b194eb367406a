"""Rates, ratios, regressions and distribution scores by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators.significance import group_quantiles, running


def association_rate(rows: DataFrame, by: list[str], value: str, cutoff: float) -> DataFrame:
    x = F.col(value)
    rate = rows.groupBy(*by).agg(F.try_divide(F.count_if(x < cutoff).cast("double"), F.count(x)).alias("rate"))
    middle = group_quantiles(rows, by, value, {"median_value": 0.5}).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "median_value")
    return rate.join(middle, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]).select(*by, "rate", "median_value")


def conditional_rates(rows: DataFrame, by: list[str], event: Column, given: Column) -> DataFrame:
    """P(event | given), P(event | not given), P(given | event), P(given | not event)."""
    share = lambda a, b: F.avg(F.when(b, a.cast("double")))
    return rows.groupBy(*by).agg(share(event, given).alias("event_given"), share(event, ~given).alias("event_not_given"), share(given, event).alias("given_event"), share(given, ~event).alias("given_not_event"))


def on_off_ratio(rows: DataFrame, by: list[str], on: Column, value: str) -> DataFrame:
    """log2 of the median while on over the median while off."""
    a, b = F.median(F.when(on, F.col(value))), F.median(F.when(~on, F.col(value)))
    out = rows.groupBy(*by).agg(a.alias("on_median"), b.alias("off_median"))
    return out.withColumn("log2_ratio", F.when((F.col("on_median") > 0) & (F.col("off_median") > 0), F.log2(F.col("on_median") / F.col("off_median"))))


def quartile_ratio(rows: DataFrame, by: list[str], value: str, on: Column) -> DataFrame:
    """Share on strictly above the 75th percentile over the share strictly below the 25th."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    both = rows.withColumn("_on", on.cast("double")).join(q, by)
    out = both.groupBy(*by).agg(F.avg(F.when(F.col(value) > F.col("q3"), F.col("_on"))).alias("top"), F.avg(F.when(F.col(value) < F.col("q1"), F.col("_on"))).alias("bottom"))
    return out.withColumn("ratio", F.try_divide("top", "bottom"))


def quartile_ratio_by_rank(rows: DataFrame, by: list[str], value: str, tie: str, on: Column) -> DataFrame:
    """The same with the floor(n / 4) greatest and least rows."""
    w = W.partitionBy(*by)
    ranked = rows.withColumn("_on", on.cast("double")).withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count("*").over(w))
    quarter = F.floor(F.col("_n") / 4)
    out = ranked.groupBy(*by).agg(F.avg(F.when(F.col("_r") > F.col("_n") - quarter, F.col("_on"))).alias("top"), F.avg(F.when(F.col("_r") <= quarter, F.col("_on"))).alias("bottom"))
    return out.withColumn("ratio", F.try_divide("top", "bottom"))


def strata_ratio(rows: DataFrame, strata: dict[str, Column], on: Column, value: str, by: list[str] = ()) -> DataFrame:
    """Medians on and off in strata that may overlap: a row counts in every stratum that holds for it; by more columns if given."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))
    rows = rows.withColumn("stratum", F.explode(names))
    middle = group_quantiles(rows.withColumn("_on", on), ["stratum", *by, "_on"], value, {"_m": 0.5})
    out = middle.groupBy("stratum", *by).agg(F.max(F.when(F.col("_on"), F.col("_m"))).alias("on_median"), F.max(F.when(~F.col("_on"), F.col("_m"))).alias("off_median"))
    return out.withColumn("log2_ratio", F.when((F.col("on_median") > 0) & (F.col("off_median") > 0), F.log2(F.col("on_median") / F.col("off_median"))))


def log_log_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of ln y on ln x over positive pairs."""
    good = rows.filter((F.col(x) > 0) & (F.col(y) > 0))
    return good.groupBy(*by).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"))


def origin_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope through the origin, and R."""
    out = rows.groupBy(*by).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    return out.select(*by, F.try_divide("xy", "xx").alias("slope"), F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).groupBy(*by).agg(F.corr(x, y).alias("r"))


def winsorized(rows: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The value clipped to the group's percentiles."""
    q = group_quantiles(rows, by, value, {"_l": low, "_h": high})
    return rows.join(q, by).withColumn("clipped", F.least(F.greatest(F.col(value), "_l"), "_h")).drop("_l", "_h")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def empirical_cdf(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the group's values that are at most this one: running counts over distinct values, then joined back."""
    keys = [*by, value]
    run = running(rows, by, value, {"n": F.count("*")})
    cdf = run.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], (F.col("run_n") / F.col("all_n")).alias("cdf"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return rows.join(cdf, same).drop(*[f"_k{i}" for i in range(len(keys))])


def log_cdf_score(rows: DataFrame, kept: DataFrame, features: dict[str, tuple[float, bool]]) -> DataFrame:
    """Weighted mean of ln of each feature's cdf over the ``kept`` pool: the share of kept values at most this one (bigger is
    better) or above it (smaller is better).  features: name to (weight, bigger); null where a share is 0."""
    weight = sum(w for w, _ in features.values())
    out, total = rows, F.lit(0.0)
    for c, (w, bigger) in features.items():
        cdf = pooled_cdf(rows, kept, c).withColumnsRenamed({"_value": f"_v_{c}", "_cdf": f"_cdf_{c}"})
        out = out.join(cdf, F.col(c).eqNullSafe(F.col(f"_v_{c}"))).drop(f"_v_{c}")
        total = total + (w / weight) * F.ln(F.col(f"_cdf_{c}") if bigger else 1 - F.col(f"_cdf_{c}"))
    return out.withColumn("score", total).drop(*[f"_cdf_{c}" for c in features])


def pooled_cdf(rows: DataFrame, sample: DataFrame, c: str, ranges: int = 64) -> DataFrame:
    """The distinct values of a column of the rows and, for each, the share of the sample with at most that value (nulls are least).
    Running counts within value ranges, started at the sums of the ranges before; where the ranges end does not matter for the
    result."""
    ends = sorted(set(rows.approxQuantile(c, [k / ranges for k in range(1, ranges)], 0.01)))
    part = F.array_size(F.filter(F.array(*[F.lit(x) for x in ends]).cast("array<double>"), lambda x: x < F.col("_value")))
    counts = rows.select(F.col(c).alias("_value"), F.lit(0).alias("n")).unionByName(sample.select(F.col(c).alias("_value"), F.lit(1).alias("n")))
    counts = counts.groupBy("_value").agg(F.sum("n").alias("n")).withColumn("_part", part)
    sums = counts.groupBy("_part").agg(F.sum("n").alias("own"))  # at most one row a range
    sums = sums.select("_part", (F.sum("own").over(W.orderBy("_part")) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy()).alias("total"))
    run = F.sum("n").over(W.partitionBy("_part").orderBy("_value"))
    return counts.withColumn("run", run).join(F.broadcast(sums), "_part").select("_value", ((F.col("before") + F.col("run")) / F.col("total")).alias("_cdf"))


def ks_statistic(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Greatest difference between the cdf of the rows of the first sample and of the others, with its sign (first minus
    other).  One pass: running counts of both samples over distinct values."""
    run = running(rows, by, value, {"a": F.count_if(first), "b": F.count_if(~first)})
    d = F.try_divide("run_a", "all_a") - F.try_divide("run_b", "all_b")
    return run.withColumn("d", d).groupBy(*by).agg(F.max_by("d", F.struct(F.abs("d"), -F.col(value))).alias("ks"))


def best_threshold(rows: DataFrame, by: list[str], value: str, good: Column) -> DataFrame:
    """Least value t at which the share of good rows above t is no more than that of bad rows at or below it crossed:
    P(good <= t) >= P(bad > t)."""
    run = running(rows, by, value, {"a": F.count_if(good), "b": F.count_if(~good)})
    crossed = F.try_divide("run_a", "all_a") >= 1 - F.try_divide("run_b", "all_b")
    return run.filter(crossed).groupBy(*by).agg(F.min(value).alias("threshold"))


def t_statistic(rows: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Student's t of the first sample against the others, with pooled variance."""
    x = F.col(value)
    one, two = F.when(first, x), F.when(~first, x)
    out = rows.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return out.select(*by, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"))


def histogram_mode(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """The middle of the fullest bin (ties: the least): the background of a distribution."""
    bins = rows.groupBy(*by, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(*by).agg(((F.max_by("bin", F.struct("n", -F.col("bin"))) + 0.5) * width).alias("mode"))


def frequency(rows: DataFrame, by: list[str], event: Column) -> DataFrame:
    """Share of a group's rows with the event (bursting frequency), and their number."""
    return rows.groupBy(*by).agg(F.avg(event.cast("double")).alias("frequency"), F.count("*").alias("n"))


def members(rows: DataFrame, by: list[str], value: str, size: int = 1000) -> DataFrame:
    """by, chunk, members and n: the values (numbers) of each group in order, joined by commas, about ``size`` of them a row.  A chunk has the values whose first
    place in the group's order is in it, so a row is bounded whatever the size of the group (but for one value's repeats)."""
    run = running(rows, by, value, {"n": F.count("*")})
    placed = run.withColumn("chunk", F.floor((F.col("run_n") - F.col("n")) / size))
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(value, "n"))), lambda x: F.array_repeat(x[value].cast("string"), x["n"].cast("int"))))
    return placed.groupBy(*by, "chunk").agg(F.array_join(each, ",").alias("members"), F.sum("n").alias("n"))
