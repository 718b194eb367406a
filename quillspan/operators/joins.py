"""Joins by distance and by interval.

Radius joins cut space into cells as wide as the radius; one side is dealt to the 3**n cells around its own, so every pair
within the radius meets in exactly one cell and no pair beyond two cells is ever compared.  Interval joins do the same with
bins of the axis; a broadcast is left to the optimizer, which checks sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import chebyshev, distance


def radius_join(a: DataFrame, b: DataFrame, axes: list[str], radius: float, by: list[str], id_a: str, id_b: str, norm: str = "euclid", strict: bool = False) -> DataFrame:
    """by, id_a, id_b and dist of pairs at most (strict: less than) ``radius`` apart; null places match nothing."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.dropna(subset=axes).select(*by, F.col(id_a), *[F.col(c).alias(f"{c}_a") for c in axes], *[cell(c).alias(f"_c{k}") for k, c in enumerate(axes)])
    right = b.dropna(subset=axes).select(*by, F.col(id_b), *[F.col(c).alias(f"{c}_b") for c in axes], *[F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias("_c0") for c in axes[:1]])
    for k, c in enumerate(axes[1:], 1):
        right = right.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(f"{c}_b") / radius).cast("long") - 1, F.floor(F.col(f"{c}_b") / radius).cast("long") + 1)))
    both = left.join(right, [*by, *[f"_c{k}" for k in range(len(axes))]])
    ends = [F.col(f"{c}_a") for c in axes], [F.col(f"{c}_b") for c in axes]
    d = distance(*ends) if norm == "euclid" else chebyshev(*ends)
    both = both.withColumn("dist", d)
    return both.filter(F.col("dist") < radius if strict else F.col("dist") <= radius).select(*by, id_a, id_b, "dist")


def nearest(pairs: DataFrame, by: list[str], id_a: str, id_b: str, k: int = 1) -> DataFrame:
    """The k nearest partners of each id_a (ties: least id_b), with rank."""
    w = W.partitionBy(*by, id_a).orderBy("dist", id_b)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def k_nearest(a: DataFrame, b: DataFrame, axes: list[str], by: list[str], id_a: str, id_b: str, k: int, radius: float | None = None, wider: int = 2) -> DataFrame:
    """by, id_a, id_b, dist and rank of the k nearest partners of every a in its group (ties: least id_b), however far they are.

    Each group's first radius is such that a point would see about 3 k partners if the group filled its box evenly (or the given one).  Rows with k
    partners within it are done; the others, written down, try a radius four times as wide, ``wider`` times, and what is left then meets its
    whole group.  Each step reads both sides once.  The result does not depend on the radius."""
    from quillspan.sources.files import written

    a, b = a.dropna(subset=axes), b.dropna(subset=axes)
    if radius is None:
        extent = [F.greatest(F.max(c) - F.min(c), F.lit(1e-12)) for c in axes]
        volume = F.lit(1.0)
        for e in extent:
            volume = volume * e
        size = F.pow(volume * 3 * k / F.count("*"), F.lit(1 / len(axes))) * 0.62
        sizes = b.groupBy(*by).agg(F.least(F.greatest(size, F.lit(1e-9)), 2 * F.greatest(*extent, F.lit(0.0))).alias("_r"))
        left, right = a.join(sizes, by), b.join(sizes, by)
    else:
        left, right = a.withColumn("_r", F.lit(float(radius))), b.withColumn("_r", F.lit(float(radius)))
    w = W.partitionBy(*by, id_a)
    out, rest = None, left.select(*by, id_a, *[F.col(c).alias(f"{c}_a") for c in axes], "_r")
    for step in range(wider + 1):
        last = step == wider
        ours, theirs = rest, right.select(*by, id_b, *[F.col(c).alias(f"{c}_b") for c in axes], F.col("_r").alias("_rb"))
        cells = [] if last else [f"_c{i}" for i in range(len(axes))]
        for c, name in zip(axes, cells, strict=not last):
            ours = ours.withColumn(name, F.floor(F.col(f"{c}_a") / (F.col("_r") * 4**step)).cast("long"))
            own = F.floor(F.col(f"{c}_b") / (F.col("_rb") * 4**step)).cast("long")
            theirs = theirs.withColumn(name, F.explode(F.sequence(own - 1, own + 1)))
        both = ours.join(theirs, [*by, *cells], "inner" if last else "left")
        both = both.withColumn("dist", distance([F.col(f"{c}_a") for c in axes], [F.col(f"{c}_b") for c in axes]))
        if last:
            ranked = both.withColumn("rank", F.row_number().over(w.orderBy("dist", id_b))).filter(F.col("rank") <= k)
            return ranked.select(*by, id_a, id_b, "dist", "rank") if out is None else out.unionByName(ranked.select(*by, id_a, id_b, "dist", "rank"))
        near = F.when(F.col("dist") <= F.col("_r") * 4**step, F.col("dist"))
        both = both.withColumn("dist", near).withColumn(id_b, F.when(near.isNotNull(), F.col(id_b)))
        both = both.withColumn("rank", F.row_number().over(w.orderBy(F.col("dist").asc_nulls_last(), id_b))).filter(F.col("rank") <= k)
        both = written(both.withColumn("_n", F.count("dist").over(w)).select(*by, id_a, id_b, "dist", "rank", "_n", "_r", *[f"{c}_a" for c in axes]))
        done = both.filter(F.col("_n") == k).select(*by, id_a, id_b, "dist", "rank")
        out = done if out is None else out.unionByName(done)
        rest = both.filter((F.col("_n") < k) & (F.col("rank") == 1)).select(*by, id_a, *[f"{c}_a" for c in axes], "_r")
        if not rest.limit(1).count():
            return out
    return out


def mutually_unique(pairs: DataFrame, by: list[str], id_a: str, id_b: str) -> DataFrame:
    """Pairs whose both ends have no other partner."""
    na, nb = F.count("*").over(W.partitionBy(*by, id_a)), F.count("*").over(W.partitionBy(*by, id_b))
    return pairs.withColumn("_a", na).withColumn("_b", nb).filter("_a = 1 and _b = 1").drop("_a", "_b")


def without_redundant(pairs: DataFrame, rows: DataFrame, by: list[str], id_: str, id_a: str, id_b: str) -> DataFrame:
    """Rows that are not the lower-numbered end of a close pair."""
    low = pairs.filter(F.col(id_a) < F.col(id_b)).select(*by, F.col(id_a).alias(id_)).distinct()
    return rows.join(low, [*by, id_], "left_anti")


def nearest_centroid(rows: DataFrame, centroids: DataFrame, axes: list[str], id_: str, name: str, most: int = 10_000) -> DataFrame:
    """The nearest centroid of each row (ties: least name), without a sort.  The centroids are broadcast as one row; more than
    ``most`` of them are an error (k_nearest joins large sets by place)."""
    few = centroids.select(name, *axes).limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} centroids: use k_nearest")
    centres = centroids.sparkSession.createDataFrame(few, centroids.select(name, *axes).schema).agg(F.array_sort(F.collect_list(F.struct(name, *axes))).alias("_all"))
    here = [F.col(c) for c in axes]
    best = F.array_min(F.transform("_all", lambda x: F.struct(distance(here, [x[c] for c in axes]).alias("dist"), x[name].alias(name))))
    found = rows.dropna(subset=axes).join(F.broadcast(centres)).withColumn("_b", best)
    return found.select(id_, F.col(f"_b.{name}").alias(name), F.col("_b.dist").alias("dist"))


def in_interval(points: DataFrame, regions: DataFrame, place: str, by: list[str], closed: str = "left") -> DataFrame:
    """Points joined to regions (start, end) that hold their place: closed left ([start, end)) or both."""
    upper = F.col(place) <= F.col("end") if closed == "both" else F.col(place) < F.col("end")
    joined = points.join(regions, by) if by else points.join(regions, F.col(place) >= F.col("start"))
    return joined.filter((F.col(place) >= F.col("start")) & upper)


def binned_in_interval(points: DataFrame, regions: DataFrame, place: str, by: list[str], width: float, closed: str = "left") -> DataFrame:
    """The same as an equi-join on bins of ``width``: regions are dealt to the bins they reach."""
    left = points.withColumn("_bin", F.floor(F.col(place) / width).cast("long"))
    right = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
    upper = F.col(place) <= F.col("end") if closed == "both" else F.col(place) < F.col("end")
    return left.join(right, [*by, "_bin"]).filter((F.col(place) >= F.col("start")) & upper).drop("_bin")


def binned_overlaps(a: DataFrame, b: DataFrame, by: list[str], width: float) -> DataFrame:
    """Rows of a (start, end) joined to rows of b (s, e) that overlap them, as an equi-join on bins of ``width``: both are dealt to
    the bins they reach, and a pair counts in the bin of its later start."""
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")))
    both = a.withColumn("_bin", reach("start", "end")).join(b.withColumn("_bin", reach("s", "e")), [*by, "_bin"])
    later = F.floor(F.greatest("start", "s") / width).cast("long")
    return both.filter((F.col("start") < F.col("e")) & (F.col("end") > F.col("s")) & (F.col("_bin") == later)).drop("_bin")


def interval_ranks(points: DataFrame, regions: DataFrame, place: str, by: list[str], closed: str = "left") -> tuple[DataFrame, DataFrame]:
    """(places, ranges): by, place, rank and n of the distinct places of each group, in order; by, start, end of the distinct regions with the ranks
    low <= rank < high of the places that they hold, and their number of points; both with _first, the number of points before them.  Places and bounds are sorted together once, so no point
    meets a region; null places and bounds match nothing."""
    keys = F.struct("start", "end")
    bounds = regions.dropna(subset=[*by, "start", "end"]).select(*by, "start", "end").distinct()
    seen = points.dropna(subset=[*by, place]).groupBy(*by, F.col(place).alias("_v")).agg(F.count("*").alias("_n"))
    none = F.lit(None).cast(dict(bounds.select(keys.alias("k")).dtypes)["k"])
    turn = F.lit(2 if closed == "both" else 0)  # of equal values: starts first, then places, then closed ends
    rows = seen.select(*by, "_v", F.lit(1).alias("_turn"), "_n", F.lit(False).alias("_end"), none.alias("_region"))
    for at, end, when in ((F.col("start"), False, F.lit(0)), (F.col("end"), True, turn)):
        rows = rows.unionByName(bounds.select(*by, at.alias("_v"), when.alias("_turn"), F.lit(0).cast("long").alias("_n"), F.lit(end).alias("_end"), keys.alias("_region")))
    w = W.partitionBy(*by).orderBy("_v", "_turn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_rank", F.sum((F.col("_turn") == 1).cast("long")).over(w)).withColumn("_below", F.sum("_n").over(w))
    places = rows.filter("_region is null").select(*by, F.col("_v").alias(place), (F.col("_rank") - 1).alias("rank"), F.col("_n").alias("n"), (F.col("_below") - F.col("_n")).alias("_first"))
    of = lambda c, end: F.max(F.when(F.col("_end") == end, F.col(c)))
    ranges = rows.filter("_region is not null").groupBy(*by, "_region").agg(of("_rank", False).alias("low"), of("_rank", True).alias("high"), (of("_below", True) - of("_below", False)).alias("n"), of("_below", False).alias("_first"))
    return places, ranges.select(*by, "_region.*", "low", "high", F.greatest("n", F.lit(0)).alias("n"), "_first")


def halving_nodes(low: Column, high: Column) -> Column:
    """Array of (level, node): the fewest runs of 2**level ranks, each from node * 2**level, that make up low <= rank < high."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(high - low)).cast("int"))

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        first, last = -F.floor(-low / size), F.floor(high / size)
        left = F.when((first < last) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("node")))
        right = F.when((first < last) & (last % 2 == 1), F.struct(level.alias("level"), (last - 1).alias("node")))
        return F.array(left, right)

    return F.when(low < high, F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull()))


def runs_above(places: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Places(by.., rank) with the level and node of each of the runs that hold their rank, up to their group's greatest level in ``nodes``."""
    top = nodes.groupBy(*by).agg(F.max("level").alias("_top"))
    above = places.join(top, by).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    return above.withColumn("node", F.floor(F.col("rank") / F.pow(F.lit(2.0), F.col("level")))).drop("_top", "rank")


def matched_in_interval(points: DataFrame, regions: DataFrame, place: str, by: list[str], closed: str = "left", keep: list[str] | None = None, block: int = 32_768) -> DataFrame:
    """The same as ``in_interval``, with the columns ``keep`` of the points (all but ``by``, if not given).

    Points in order of their places make blocks of ``block`` as one array each, and a region holds a run of them, so it goes to the blocks of its run
    and takes a slice of each: each pair that matches is made once where it leaves, no other meets, and what is moved is the points once and
    the regions once for each ``block`` points they hold.  Blocks are joined by sort-merge: by the size of their files they would be sent to all tasks."""
    keep = [c for c in points.columns if c not in by] if keep is None else keep
    places, ranges = interval_ranks(points, regions, place, by, closed)
    value = F.col(keep[0]) if len(keep) == 1 else F.struct(*keep)
    near = W.partitionBy(*by, place).orderBy("_first")
    at = points.select(*by, place, value.alias("_value")).join(places.select(*by, place, "_first"), [*by, place])
    at = at.select(*by, "_value", (F.col("_first") + F.row_number().over(near) - 1).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", F.struct("_value").alias("_v"))))
    blocks = at.groupBy(*by, F.floor(F.col("_at") / block).alias("_block")).agg(F.transform(ordered, lambda x: x["_v"]["_value"]).alias("_values"))
    held = regions.join(ranges.filter("n > 0").select(*by, "start", "end", "_first", (F.col("_first") + F.col("n")).alias("_end")), [*by, "start", "end"])
    held = held.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_end") - 1) / block))))
    skip = F.greatest(F.col("_first") - F.col("_block") * block, F.lit(0)).cast("int")
    length = F.least(F.col("_end") - F.col("_block") * block, F.lit(block)).cast("int") - skip
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: few rows meet here, but many leave
    held = held.select(*regions.columns, "_block", skip.alias("_skip"), length.alias("_length")).repartition(tasks, *by, "_block")
    both = held.join(blocks.repartition(tasks, *by, "_block").hint("merge"), [*by, "_block"])
    taken = F.when(F.col("_length") == F.size("_values"), F.col("_values")).otherwise(F.slice("_values", F.col("_skip") + 1, F.col("_length")))
    theirs = [c for c in regions.columns if c not in by]
    return both.select(*by, F.explode(taken).alias("_value"), *theirs).select(*by, *([F.col("_value").alias(keep[0])] if len(keep) == 1 else [F.col(f"_value.{c}").alias(c) for c in keep]), *theirs)


def with_region(points: DataFrame, regions: DataFrame, place: str, by: list[str], region: str, closed: str = "left", last: bool = False) -> DataFrame:
    """Points with the least (``last``: greatest) region that holds their place; those without any are left out.

    Each region goes to the few runs of ranks that make it up and each distinct place to the runs above it, so the work is n log n, however many
    regions hold a place."""
    best = F.max if last else F.min
    places, ranges = interval_ranks(points, regions, place, by, closed)
    named = ranges.join(regions.groupBy(*by, "start", "end").agg(best(region).alias(region)), [*by, "start", "end"])
    nodes = named.select(*by, region, F.explode(halving_nodes(F.col("low"), F.col("high"))).alias("_at")).groupBy(*by, "_at.level", "_at.node").agg(best(region).alias(region))
    above = runs_above(places.select(*by, place, "rank"), nodes, by)
    found = above.join(nodes, [*by, "level", "node"]).groupBy(*by, place).agg(best(region).alias(region))
    return points.join(found, [*by, place])


def points_in_regions(points: DataFrame, regions: DataFrame, place: str, by: list[str], region: str, closed: str = "left") -> DataFrame:
    """region and n, the number of points in it, from the numbers of points up to its ends; 0 without any."""
    _, ranges = interval_ranks(points, regions, place, by, closed)
    n = regions.join(ranges, [*by, "start", "end"]).groupBy(region).agg(F.sum("n").alias("n"))
    return regions.select(region).join(n, region, "left").select(region, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _cut_shares(marks: DataFrame, regions: DataFrame, by: list[str], inside: str, outside: str, bound: str, sign: int) -> tuple[DataFrame, DataFrame]:
    """(ranges, cut): of every distinct region the marks whose end ``inside`` lies in it; of those the number _k and summed share _x of
    them that go beyond its ``bound``.  In each run of ranks marks and bounds are sorted once by the other end."""
    places, ranges = interval_ranks(marks, regions, inside, by)
    nodes = ranges.select(*by, "start", "end", F.explode(halving_nodes(F.col("low"), F.col("high"))).alias("_at")).select(*by, "start", "end", "_at.*")
    one = marks.dropna(subset=[*by, "s", "e"]).groupBy(*by, "s", "e").agg(F.count("*").alias("_k"))
    one = one.join(runs_above(places.select(*by, inside, "rank"), nodes, by), [*by, inside])
    w = W.partitionBy(*by, "level", "node")
    one = one.select(*by, "level", "node", (-sign * F.col(outside)).alias("_v"), F.lit(1).alias("_turn"), "_k", F.col(inside).alias("_in"), (F.col("_k") / (F.col("e") - F.col("s"))).alias("_u"))
    ask = nodes.select(*by, "level", "node", (-sign * F.col(bound)).alias("_v"), F.lit(0).alias("_turn"), "start", "end")
    both = one.unionByName(ask, allowMissingColumns=True).withColumn("_o", F.min("_in").over(w))  # near the run, so that little cancels
    running = w.orderBy("_v", "_turn").rowsBetween(W.unboundedPreceding, 0)
    sums = {"_n": F.col("_k"), "_su": F.col("_u"), "_siu": (F.col("_in") - F.col("_o")) * F.col("_u")}
    for c, x in sums.items():
        both = both.withColumn(c, F.coalesce(F.sum(x).over(running), F.lit(0)))
    share = sign * ((F.col(bound) - F.col("_o")) * F.col("_su") - F.col("_siu"))
    return ranges, both.filter("_turn = 0").groupBy(*by, "start", "end").agg(F.sum("_n").alias("_k"), F.sum(share).alias("_x"))


def overlapping_counts(regions: DataFrame, marks: DataFrame, region: str, mark: str, by: list[str], width: float) -> DataFrame:
    """Of every region (start, end): n, the sum over marks (s, e) with an end inside [start, end) of the share of the mark that lies in
    it; 0 without any.  Marks that do not go beyond the region count 1, the others by sums over sorted ends, so no mark meets a region;
    marks without a length have no share.  ``mark`` and ``width`` do not decide the result."""
    marks = marks.filter("s < e")
    ranges, over = _cut_shares(marks, regions, by, "s", "e", "end", 1)
    _, under = _cut_shares(marks, regions, by, "e", "s", "start", -1)
    keys = [*by, "start", "end"]
    parts = ranges.select(*keys, F.col("n").cast("double").alias("n")).unionByName(over.select(*keys, (F.col("_x") - F.col("_k")).alias("n"))).unionByName(under.select(*keys, F.col("_x").alias("n")))
    n = regions.join(parts.groupBy(*keys).agg(F.sum("n").alias("n")), keys).groupBy(region).agg(F.sum("n").alias("n"))
    return regions.select(region).join(n, region, "left").select(region, F.coalesce("n", F.lit(0.0)).alias("n"))


def first_match(joined: DataFrame, key: list[str], order: str) -> DataFrame:
    return joined.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("_r = 1").drop("_r")


def last_match(joined: DataFrame, key: list[str], order: str) -> DataFrame:
    return joined.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the overlap over the length of a; 0 if they do not meet."""
    return F.try_divide(F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)).cast("double"), (a_end - a_start).cast("double"))


def matched_seeds(pairs: DataFrame, by: list[str], id_a: str, id_b: str, unique: bool = True) -> DataFrame:
    """The nearest partner of each a; with ``unique`` only where no other a has the same one."""
    first = nearest(pairs, by, id_a, id_b)
    if not unique:
        return first
    return first.withColumn("_n", F.count("*").over(W.partitionBy(*by, id_b))).filter("_n = 1").drop("_n")


def folds(places: DataFrame, regions: DataFrame, id_: str, region: str, fold: str, by: list[str]) -> DataFrame:
    """region and the sum of the folds of the places (``place``) of which it is the first region (closed); 0 without any.  Of rows of one id
    one counts: that with the first region, then the least fold."""
    first = with_region(places, regions, "place", by, region, "both").groupBy(id_).agg(F.min(F.struct(region, fold)).alias("_m"))
    n = first.groupBy(f"_m.{region}").agg(F.sum(f"_m.{fold}").alias(fold))
    return regions.select(region).join(n, region, "left").withColumn(fold, F.coalesce(fold, F.lit(0)))


def merged(rows: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with the values of the matching row of the other table in place of their own, and its further columns."""
    more = [c for c in other.columns if c not in (*keys, *values)]
    o = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], *more)
    out = rows.join(o, keys, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in rows.columns], *more)
