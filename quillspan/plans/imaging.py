"""Queries of clouds, meshes and picks; same conventions as the catalog, which they join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import clouds, density, picking
from quillspan.plans.catalog import P, points, query, r6, table

_XYZ = ["z", "x", "y"]


def _cloud(spark, sf):
    return clouds.clouds(points(spark, sf), "cls", 0.05, 1.0, 2, normal="count")


@query(f"""WITH {P}, s AS (SELECT trace, cls, z / 0.05 AS z, x / 0.05 AS x, y / 0.05 AS y FROM pts WHERE z IS NOT NULL), n AS (SELECT trace, cls, count(*) AS n FROM s GROUP BY 1, 2), o AS (SELECT unnest(range(-2, 3)) AS o)
SELECT s.trace, s.cls AS "group", round(z)::BIGINT + a.o AS vz, round(x)::BIGINT + b.o AS vx, round(y)::BIGINT + c.o AS vy, round(sum(exp(-(pow(round(z) + a.o - z, 2) + pow(round(x) + b.o - x, 2) + pow(round(y) + c.o - y, 2)) / 2)) / any_value(n), 6) AS density
FROM s JOIN n ON n.trace = s.trace AND n.cls = s.cls, o a, o b, o c GROUP BY 1, 2, 3, 4, 5""")
def spot_clouds(spark, sf):
    return _cloud(spark, sf).select("trace", "group", "vz", "vx", "vy", *r6("density"))


@query()
def cloud_maxima(spark, sf):
    return clouds.local_maxima(_cloud(spark, sf))


@query()
def mesh_neighbours(spark, sf):
    return clouds.mesh_neighbours(points(spark, sf), "trace", "locus", _XYZ)


@query()
def drift_in_mesh(spark, sf):
    """Moves from each locus to the next."""
    p = points(spark, sf).dropna(subset=_XYZ)
    after = p.select("trace", (F.col("locus") - 1).alias("locus"), *[F.col(c).alias(f"n{c}") for c in _XYZ])
    moves = p.join(after, ["trace", "locus"]).select("trace", "locus", *_XYZ, *[(F.col(f"n{c}") - F.col(c)).alias(f"d{c}") for c in _XYZ])
    return clouds.steady_in_mesh(moves, "trace", "locus", _XYZ, [f"d{c}" for c in _XYZ]).select("trace", "locus", *r6("off"))


def _spots(spark, sf, of: str):
    """Five vectors stand for the candidates of a locus, 25 loci for a trace or a cell."""
    seen = F.col("vec_id") % 11 != 0
    axis = lambda i: F.when(seen, F.col("embedding")[i].cast("double"))
    place = F.floor(F.col("vec_id") / 5)
    return table(spark, sf, "embeddings").select(F.floor(place / 25).cast("long").alias(of), (place % 25).cast("long").alias("locus"), (F.col("vec_id") % 5).cast("long").alias("candidate"), axis(0).alias("z"), axis(1).alias("x"), axis(2).alias("y"), (F.col("label") + 1.0).alias("brightness"))


@query()
def picks_in_population(spark, sf):
    return picking.pick_in_population(_spots(spark, sf, "trace"), least_change=0.01)[0]


@query()
def picks_of_homologs(spark, sf):
    """The homologs' places are the centres of a cell's candidates of the lower and of the upper half of z."""
    rows = _spots(spark, sf, "cell")
    middle = rows.groupBy("cell").agg(F.median("z").alias("_m"))
    halves = rows.dropna(subset=_XYZ).join(middle, "cell").groupBy("cell", (F.col("z") > F.col("_m")).cast("long").alias("homolog")).agg(*[F.avg(c).alias(c) for c in _XYZ])
    return picking.pick_homologs(rows, halves)


@query()
def axis_frame(spark, sf):
    return density.axis_frame(points(spark, sf), "cls", "A", "B").select("trace", "locus", *r6("along", "second", "third"))
