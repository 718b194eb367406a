"""Boundary and domain callers on maps and traces.

A map is a table (trace, i, j, value) of all ordered pairs of loci that are known; loci are numbered from 0 without gaps, null values are
unknown.  Sums over windows and triangles of a map come from prefix sums kept as rows: a window is a few lookups by an equi-join,
whatever its size.  What depends on earlier choices (dropping boundaries one at a time) is a grouped-map function over a trace.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators.peaks import peak_places
from quillspan.operators.segments import XYZ, filled, merged_cuts

SEGMENTS = "trace long, segment long, first long, last long"


def mirrored(half: DataFrame) -> DataFrame:
    """The rows (i, j, ...) and the same for (j, i)."""
    return half.unionByName(half.select(*[F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in half.columns]))


def _rows(band: DataFrame, name: str) -> DataFrame:
    return band.groupBy("trace", F.col("i").alias("locus")).agg(F.sum("value").alias(f"s_{name}"), F.count("value").alias(f"n_{name}"))


def band_ratios(map_: DataFrame, width: int = 5, length: int = 5) -> DataFrame:
    """trace, c and ratio of the places c around which bands of the map fit.

    The band of a locus is the mean of its ``width`` values next to the diagonal; ``forward`` compares those towards greater loci of the ``length`` loci before c
    (above) with those from c on (below), ``backward`` those towards smaller loci, the other way round.  ``ratio`` is the greater of both where both
    fit.  Means skip unknown values; a ratio without a known value on a side, or over 0, is null."""
    size = map_.groupBy("trace").agg((F.max("i") + 1).alias("n"))
    loci = size.select("trace", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("locus"))
    ahead, back = _rows(map_.filter(f"j - i between 1 and {width}"), "f"), _rows(map_.filter(f"i - j between 1 and {width}"), "b")
    rows = loci.join(ahead, ["trace", "locus"], "left").join(back, ["trace", "locus"], "left")
    w = W.partitionBy("trace").orderBy("locus")
    mean = lambda x, low, high: F.try_divide(F.sum(f"s_{x}").over(w.rowsBetween(low, high)), F.sum(f"n_{x}").over(w.rowsBetween(low, high)))
    forward = F.try_divide(mean("f", -length, -1), mean("f", 0, length - 1))
    backward = F.try_divide(mean("b", 0, length - 1), mean("b", -length, -1))
    rows = rows.withColumn("forward", F.when((F.col("locus") >= length) & (F.col("locus") + length - 1 + width < F.col("n")), forward))
    rows = rows.withColumn("backward", F.when((F.col("locus") >= length + width) & (F.col("locus") + length - 1 < F.col("n")), backward))
    return rows.select("trace", F.col("locus").alias("c"), F.greatest("forward", "backward").alias("ratio")).filter("ratio is not null")


def valley_maxima(ratios: DataFrame, valley: int = 5, least: float = 1.0) -> DataFrame:
    """trace and c of the ratios above ``least`` that are the greatest of the ``valley`` places before and the ``valley`` - 1 after."""
    w = W.partitionBy("trace").orderBy("c").rangeBetween(-valley, valley - 1)
    return ratios.withColumn("_m", F.max("ratio").over(w)).filter((F.col("ratio") == F.col("_m")) & (F.col("ratio") > least)).select("trace", "c", "ratio")


def arrowhead(map_: DataFrame) -> DataFrame:
    """The map of how much nearer a locus is to the one d after it than to the one d before: (before - after) / (before + after) at (i, i + d)
    and (i + d, i); 0 on the diagonal, null where there is no locus before or a value is unknown."""
    off = map_.filter("i <> j").groupBy("trace", "i", F.abs(F.col("j") - F.col("i")).alias("d"))
    both = off.agg(F.max(F.when(F.col("j") > F.col("i"), F.col("value"))).alias("after"), F.max(F.when(F.col("j") < F.col("i"), F.col("value"))).alias("before"), F.max((F.col("j") > F.col("i")).cast("int")).alias("_has"))
    value = F.try_divide(F.col("before") - F.col("after"), F.col("before") + F.col("after"))
    up = both.filter("_has = 1").select("trace", "i", (F.col("i") + F.col("d")).alias("j"), value.alias("value"))
    ends = map_.groupBy("trace").agg(F.max("i").alias("n")).select("trace", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("i"))
    return mirrored(up).unionByName(ends.select("trace", "i", F.col("i").alias("j"), F.lit(0.0).alias("value")))


_MEASURES = ["s", "g", "k", "q"]  # sum, sign, number and squares of the known values


def prefix_sums(map_: DataFrame) -> DataFrame:
    """trace, row, col and, for the value, its sign, its being known and its square: ``col_x`` over the rows up to this one of its column,
    ``rect_x`` over the rectangle up to row and column, ``slope_x`` the sum of ``col_x`` along (row - m, col - 2m) and (row - m, col - 2m - 1)."""
    v = F.col("value")
    known = {"s": F.coalesce(v, F.lit(0.0)), "g": F.coalesce(F.signum(v), F.lit(0.0)), "k": v.isNotNull().cast("double"), "q": F.coalesce(v * v, F.lit(0.0))}
    size = map_.groupBy("trace").agg(F.greatest(F.max("i"), F.max("j")).alias("n"))
    grid = size.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), "n"))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), "n")))
    rows = grid.join(map_.select("trace", F.col("i").alias("row"), F.col("j").alias("col"), "value"), ["trace", "row", "col"], "left").select("trace", "row", "col", *[c.alias(x) for x, c in known.items()])
    down, along, slope = W.partitionBy("trace", "col").orderBy("row"), W.partitionBy("trace", "row").orderBy("col"), W.partitionBy("trace", F.col("col") - 2 * F.col("row")).orderBy("row")
    rows = rows.select("trace", "row", "col", *[F.sum(x).over(down).alias(f"col_{x}") for x in _MEASURES])
    rows = rows.select("*", *[F.sum(f"col_{x}").over(along).alias(f"rect_{x}") for x in _MEASURES], *[(F.col(f"col_{x}") + F.coalesce(F.lag(f"col_{x}").over(along), F.lit(0.0))).alias(f"two_{x}") for x in _MEASURES])
    return rows.select("*", *[F.sum(f"two_{x}").over(slope).alias(f"slope_{x}") for x in _MEASURES]).drop(*[f"two_{x}" for x in _MEASURES])


def window_sums(prefix: DataFrame, windows: DataFrame) -> DataFrame:
    """windows(trace, id, r0, r1, c0, c1) with ``total`` and ``known`` of the values in rows r0 .. r1 - 1 and columns c0 .. c1 - 1: four lookups."""
    corner = lambda r, c, sign: F.struct((F.col(r) - 1).alias("row"), (F.col(c) - 1).alias("col"), F.lit(sign).alias("sign"))
    asked = windows.select("trace", "id", F.explode(F.array(corner("r1", "c1", 1.0), corner("r0", "c1", -1.0), corner("r1", "c0", -1.0), corner("r0", "c0", 1.0))).alias("x")).select("trace", "id", "x.*")
    sums = asked.join(prefix, ["trace", "row", "col"], "left").groupBy("trace", "id").agg(*[F.coalesce(F.sum(F.col("sign") * F.col(f"rect_{x}")), F.lit(0.0)).alias(n) for x, n in (("s", "total"), ("k", "known"))])
    return windows.join(sums, ["trace", "id"])


def triangle_features(map_: DataFrame) -> DataFrame:
    """trace, i < j, sign, sum and var of the two triangles that an arrow from (i, j) points out, both of size c.

    Columns q = 0 .. 2c - 1 of the left one, from j - 2c on, have rows i - c .. i - c + e - 1, of the right one, from j on, rows i + e .. i + c - 1, where e =
    floor((q + 1) / 2).  c is j - i, or where that does not fit the greatest that does, at least 1.  ``sign`` and ``sum`` are left less right,
    ``var`` is the variance of all known values.  Each triangle is made of the prefix sums at its corners and along its slope."""
    n = map_.groupBy("trace").agg((F.max("i") + 1).alias("n"))
    d = F.col("j") - F.col("i")
    fits = (F.col("i") >= d) & (F.col("j") + 2 * d <= F.col("n"))
    c = F.when(fits, d).otherwise(F.least(F.col("i"), F.floor((F.col("n") - F.col("j")) / 2)))
    loci = n.select("trace", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("i")).filter("i < n - 1")
    pairs = loci.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1))).withColumn("c", c).filter("c >= 1")

    def term(kind: str, row: Column, col: Column, left: float, right: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row"), col.cast("long").alias("col"), F.lit(left).alias("left"), F.lit(right).alias("right"))

    i, j, c = F.col("i"), F.col("j"), F.col("c")
    terms = [
        # left: sums down to row i - c + e - 1 of each column (e = 0 has none, e = c one column), less those down to row i - c - 1
        term("slope", i - 2, j - 2, 1.0, 0.0),
        term("slope", i - c - 1, j - 2 * c, -1.0, 0.0),
        term("col", i - 1, j - 1, 1.0, 0.0),
        term("col", i - c - 1, j - 2 * c, 1.0, 0.0),
        term("rect", i - c - 1, j - 1, -1.0, 0.0),
        term("rect", i - c - 1, j - 2 * c - 1, 1.0, 0.0),
        # right: sums down to row i + c - 1 of each column, less those down to row i + e - 1
        term("rect", i + c - 1, j + 2 * c - 1, 0.0, 1.0),
        term("rect", i + c - 1, j - 1, 0.0, -1.0),
        term("col", i - 1, j, 0.0, -1.0),
        term("slope", i + c - 2, j + 2 * c - 2, 0.0, -1.0),
        term("slope", i - 1, j, 0.0, 1.0),
        term("col", i + c - 1, j + 2 * c - 1, 0.0, -1.0),
    ]
    asked = pairs.select("trace", "i", "j", F.explode(F.array(*terms)).alias("x")).select("trace", "i", "j", "x.*")
    found = asked.join(prefix_sums(map_), ["trace", "row", "col"])
    value = lambda x: F.when(F.col("kind") == "slope", F.col(f"slope_{x}")).when(F.col("kind") == "col", F.col(f"col_{x}")).otherwise(F.col(f"rect_{x}"))
    sums = found.groupBy("trace", "i", "j").agg(*[F.sum(F.col(side) * value(x)).alias(f"{side}_{x}") for side in ("left", "right") for x in _MEASURES])
    sums = pairs.select("trace", "i", "j").join(sums, ["trace", "i", "j"], "left").fillna(0.0)
    both = lambda x: F.col(f"left_{x}") + F.col(f"right_{x}")
    var = F.try_divide(both("q"), both("k")) - F.pow(F.try_divide(both("s"), both("k")), F.lit(2.0))
    return sums.select("trace", "i", "j", F.round(F.col("left_g") - F.col("right_g")).cast("long").alias("sign"), (F.col("left_s") - F.col("right_s")).alias("sum"), F.when(both("k") > 0, F.greatest(var, F.lit(0.0))).alias("var"))


def arrow_lines(features: DataFrame, loci: DataFrame) -> DataFrame:
    """trace, start and, along the line of edges of arrows from ``start``, the mean sign and sum.

    The line of start s has points r = |s| + t, c = max(s, 0) + t / 2 for t = 0, 1, ..., r < n; where c lies between two columns, their mean counts.
    Features are symmetric and 0 where there is none; starts from -n / 2 (towards 0) to n - 1."""
    n = loci.groupBy("trace").agg(F.count("*").alias("n"))
    starts = n.select("trace", "n", F.explode(F.sequence(-F.floor(F.col("n") / 2).cast("long"), F.col("n") - 1)).alias("start"))
    t = starts.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1 - F.abs("start"))))
    c = F.greatest(F.col("start"), F.lit(0)) + F.col("t") / 2
    cells = t.select("trace", "start", (F.abs("start") + F.col("t")).alias("row"), F.explode(F.array(F.floor(c), F.ceil(c))).alias("col"))
    both = mirrored(features).select("trace", F.col("i").alias("row"), F.col("j").alias("col"), "sign", "sum")
    found = cells.join(both, ["trace", "row", "col"], "left").fillna(0, ["sign"]).fillna(0.0, ["sum"])
    return found.groupBy("trace", "start").agg(F.avg("sign").alias("sign"), F.avg("sum").alias("sum"))


def arrow_boundaries(features: DataFrame, loci: DataFrame, least: int = -5) -> DataFrame:
    """trace and c of the domain boundaries that arrows end on.

    Lines whose mean sign and mean sum both peak (the places at most 1 apart, peaks at least 3 apart and 2 wide, starts above ``least``) are
    taken with the lines beside them; places where the sum peaks along two or more of them (2 apart, 2 wide; runs of places at most 1 apart
    are one, and the run that no further place follows is open and not used) make a boundary at their rounded mean.  Peaks are found over a whole trace: a grouped-map
    function."""

    def work(pdf: pd.DataFrame, feature: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"trace": [], "c": []})
        pdf = pdf.sort_values("start")
        if len(pdf) < 3 or not len(feature):
            return none
        starts, n = pdf["start"].to_numpy(), int(pdf["start"].max()) + 1
        lines = []
        for name in ("sign", "sum"):
            at = peak_places(pdf[name].to_numpy(float), 3, 0.0, 2.0)[0]
            lines.append(at[starts[at] > least])
        shared = [min([k, *lines[1][np.abs(lines[1] - k) <= 1]]) for k in lines[0] if (np.abs(lines[1] - k) <= 1).any()]
        if not shared:
            return none
        grid = np.zeros((n, n))
        i, j = feature["i"].to_numpy(int), feature["j"].to_numpy(int)
        grid[i, j] = grid[j, i] = feature["sum"].to_numpy(float)
        places = []
        for k in sorted({k + o for k in shared for o in (-1, 0, 1) if 0 <= k + o < len(starts)}):
            s = int(starts[k])
            t = np.arange(n - abs(s))
            col = max(s, 0) + t / 2
            line = (grid[abs(s) + t, np.floor(col).astype(int)] + grid[abs(s) + t, np.ceil(col).astype(int)]) / 2
            places += (abs(s) + t)[peak_places(line, 2, 0.0, 2.0)[0]].tolist()
        runs, run = [], []
        for p in sorted(places):
            if run and min(abs(p - q) for q in run) > 1:
                runs.append(run)
                run = []
            run.append(p)
        runs.append(run)
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "c": sorted(round(float(np.mean(r))) for r in runs if len(r) > 1)})

    return arrow_lines(features, loci).groupBy("trace").cogroup(features.groupBy("trace")).applyInPandas(work, "trace long, c long")


def population_map(pairs: DataFrame) -> DataFrame:
    """i < j and the median distance over all traces, as ``value``."""
    return pairs.filter("i < j").groupBy("i", "j").agg(F.percentile("dist", F.lit(0.5)).alias("value"))


def iterative_domains(points: DataFrame, size: int, normal: DataFrame | None = None, rounds: int = 5, levels: int = 1, scale_correlation: float = 1.0, scale_distance: float = 1.0, most_distance: float = 0.8, most_correlation: float = 0.05, flexible: float = 0.2) -> DataFrame:
    """SEGMENTS, ``rounds`` done and whether they ``settled``: domains called, split and merged again until no boundary changes.

    First boundaries are dropped from runs of ``size`` loci as by ``segments.merged_domains``.  Then, each round, every domain longer than 2 * ``size`` is called anew on its
    own (``levels`` times, the correlation bound times ``scale_correlation``), all boundaries together are merged over the whole trace (the distance bound times
    ``scale_distance``), and the round's boundaries are compared with the last ones.  ``normal`` (i, j, value), as of ``population_map``, divides distances, so that
    what all traces share is no domain; it is joined to the trace's pairs by (i, j), not sent whole.  A trace that still
    changes after ``rounds`` is given as it stands, with ``settled`` false."""
    bounds = {"most_distance": most_distance, "most_correlation": most_correlation, "flexible": flexible}

    def work(pdf: pd.DataFrame, ratio: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("locus")
        xyz, loci = pdf[XYZ].to_numpy(float), pdf["locus"].to_numpy()
        if not len(loci) or (~np.isnan(xyz).any(1)).sum() < 2:
            return pd.DataFrame({c: [] for c in ("trace", "segment", "first", "last", "rounds", "settled")})
        scale = np.ones((len(loci), len(loci)))
        if ratio is not None:
            a, b = np.searchsorted(loci, ratio["i"]), np.searchsorted(loci, ratio["j"])
            scale[a, b] = scale[b, a] = ratio["value"]

        def called(low: int, high: int, starts: list[int] | None, by_correlation: float, by_distance: float) -> list[int]:
            part = xyz[low:high]
            if (~np.isnan(part).any(1)).sum() < 2:
                return [0]
            d = np.sqrt(((part[:, None] - part[None]) ** 2).sum(-1)) / scale[low:high, low:high]
            whole = np.column_stack([filled(part[:, k]) for k in range(3)])
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.corrcoef(np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1)) / scale[low:high, low:high])
            cuts = list(range(0, high - low, size)) if starts is None else starts
            return merged_cuts(d, corr, cuts, **{**bounds, "most_correlation": most_correlation * by_correlation, "most_distance": most_distance * by_distance})

        n = len(loci)
        cuts, done, settled = called(0, n, None, 1.0, 1.0), 0, False
        while done < rounds and not settled:
            split = set(cuts)
            for _ in range(levels):
                edges = [*sorted(split), n]
                for low, high in zip(edges, edges[1:], strict=False):
                    if high - low > 2 * size:
                        split |= {low + x for x in called(low, high, None, scale_correlation, 1.0)}
            new = called(0, n, sorted(split), 1.0, scale_distance)
            settled, cuts, done = new == cuts, new, done + 1
        edges = np.array([*cuts[1:], n])
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "segment": range(len(cuts)), "first": loci[cuts], "last": loci[edges - 1], "rounds": done, "settled": settled})

    schema = f"{SEGMENTS}, rounds int, settled boolean"
    rows = points.select("trace", "locus", *XYZ)
    if normal is None:
        return rows.groupBy("trace").applyInPandas(lambda pdf: work(pdf), schema)
    values = _scales(normal, rows.select("trace", "locus"))
    return rows.groupBy("trace").cogroup(values.groupBy("of")).applyInPandas(lambda pdf, ratio: work(pdf, ratio), schema)


def _scales(normal: DataFrame, loci: DataFrame) -> DataFrame:
    """The known values of a population map for the pairs of loci that each trace has."""
    i = loci.withColumnRenamed("locus", "i").join(normal.filter("i < j and value > 0").select("i", "j", "value"), "i")
    return i.join(loci.withColumnRenamed("locus", "j"), ["trace", "j"]).select(F.col("trace").alias("of"), "i", "j", "value")


def local_domains(points: DataFrame, size: int, cutoff: float, context: int = 1000, most: float = 0.66) -> DataFrame:
    """SEGMENTS of each trace's detected loci.

    Candidate boundaries are the places at which the centres of the ``size`` loci before and from there on are farther apart than at the ``size`` places before and
    the ``size`` - 1 after, but for the outermost ``size``.  The contacts (nearer than ``cutoff``) of the two domains beside a boundary with the ``context`` loci on each side of it make two mean
    rows; the boundary whose rows correlate most goes first, while that is above ``most``.  Rows that do not vary correlate with nothing.

    Only contacts within a boundary's context are worked out, for one boundary at a time and in blocks of rows, and after a boundary goes only the two beside it
    are worked out again: memory grows with a trace's loci, not with their square."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("locus")
        xyz, loci = pdf[XYZ].to_numpy(float), pdf["locus"].to_numpy()
        n = len(loci)
        if not n:
            return pd.DataFrame({c: [] for c in ("trace", "segment", "first", "last")})
        sums = np.vstack([np.zeros(3), np.cumsum(xyz, 0)])
        at = np.arange(n)
        low, high = np.maximum(at - size, 0), np.minimum(at + size, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = np.sqrt((((sums[at] - sums[low]) / (at - low)[:, None] - (sums[high] - sums[at]) / (high - at)[:, None]) ** 2).sum(1))
        known = np.where(np.isnan(apart), -np.inf, apart)
        top = np.array([known[max(k - size, 0) : k + size].max() for k in range(n)])
        cuts = [k for k in range(n) if known[k] == top[k] > 0 and size < k < n - size]

        def alike(a: int, b: int, c: int) -> float:
            near = xyz[max(b - context, 0) : b + context]
            rows = []
            for low, high in ((a, b), (b, c)):
                total = np.zeros(len(near))
                for k in range(low, high, 512):
                    total += (np.sqrt(((xyz[k : min(k + 512, high), None] - near[None]) ** 2).sum(-1)) < cutoff).sum(0)
                row = total / (high - low)
                rows.append(row - row.mean())
            size_ = np.sqrt((rows[0] ** 2).mean() * (rows[1] ** 2).mean())
            return float((rows[0] * rows[1]).mean() / size_) if size_ > 0 else -2.0

        before, after = dict(zip(cuts, [0, *cuts[:-1]], strict=True)) if cuts else {}, dict(zip(cuts, [*cuts[1:], n], strict=True)) if cuts else {}
        now = {b: alike(before[b], b, after[b]) for b in cuts}
        heap = [(-v, b) for b, v in now.items()]
        heapq.heapify(heap)
        while heap:
            value, b = heapq.heappop(heap)
            if now.get(b) != -value:
                continue
            if -value <= most:
                break
            del now[b]
            a, c = before[b], after[b]
            for x, side in ((a, after), (c, before)):
                if x in now:
                    side[x] = c if side is after else a
                    now[x] = alike(before[x], x, after[x])
                    heapq.heappush(heap, (-now[x], x))
        starts = [0, *sorted(now)]
        ends = np.array([*starts[1:], n]) - 1
        return pd.DataFrame({"trace": pdf["trace"].iloc[0], "segment": range(len(starts)), "first": loci[starts], "last": loci[ends]})

    return points.select("trace", "locus", *XYZ).groupBy("trace").applyInPandas(work, SEGMENTS)
