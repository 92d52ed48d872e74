"""Nearest neighbours and spatial joins by bucket equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G
from ..sources.shared import store


def nearest(points: DataFrame, sources: DataFrame, k: int = 1, cell: float = 1.0, within: float | None = None) -> DataFrame:
    """point_id, rank (from 1), elem_id, distance: the k nearest sources (elem_id, x, y) of each point (point_id, x, y); ties by elem_id.

    Points meet the sources of their bucket and the eight around it. That is exact for sources within `cell`; points that have found
    fewer than k there look again in buckets of twice the size, until all have k or the extent is covered. With `within`, buckets have that size.
    """
    found = None
    todo, size = points.select("point_id", "x", "y"), float(cell)
    if within is not None:
        return _ring(todo, sources, float(within) if within > 0 else size, k).filter(F.col("distance") <= within)
    spark = points.sparkSession
    ends = sources.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not ends[4]:
        return spark.createDataFrame([], "point_id long, rank int, elem_id int, distance double")
    k = min(k, ends[4])
    extent = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if extent[0] is None:
        return spark.createDataFrame([], "point_id long, rank int, elem_id int, distance double")
    reach = max(max(ends[1], extent[1]) - min(ends[0], extent[0]), max(ends[3], extent[3]) - min(ends[2], extent[2])) + size
    while True:
        near = store(_ring(todo, sources, size, k))
        last = size > reach
        sure = near if last else near.filter(F.col("distance") <= size)
        full = sure.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("point_id")
        done = near.join(full, "point_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        todo = store(todo.join(full, "point_id", "left_anti"))
        if not todo.limit(1).count():
            return found
        size *= 2


def _ring(points: DataFrame, sources: DataFrame, size: float, k: int) -> DataFrame:
    b = lambda c: F.floor(F.col(c) / size).cast("long")
    s = sources.select("elem_id", F.col("x").alias("sx"), F.col("y").alias("sy"), b("x").alias("bx"), b("y").alias("by"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.withColumn("bx", b("x")).withColumn("by", b("y")).withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    p = p.select("point_id", "x", "y", (F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by"))
    d = p.join(s, ["bx", "by"]).withColumn("distance", F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2))
    w = Window.partitionBy("point_id").orderBy("distance", "elem_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("point_id", "rank", "elem_id", "distance")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, how: str = "inner", geom: str = "geom") -> DataFrame:
    """Spatial join: points (x, y) with the polygons that contain them. Polygons go to all tiles that their box meets, points to one."""
    x0, y0, x1, y1 = G.bounds(F.col(geom))
    t = lambda v: F.floor(v / cell).cast("long")
    tiles = polygons.withColumn("__tx", F.explode(F.sequence(t(x0), t(x1)))).withColumn("__ty", F.explode(F.sequence(t(y0), t(y1))))
    p = points.withColumn("__tx", t(F.col("x"))).withColumn("__ty", t(F.col("y")))
    on = (p["__tx"] == tiles["__tx"]) & (p["__ty"] == tiles["__ty"]) & G.contains(tiles[geom], p["x"], p["y"])
    out = p.join(tiles, on, {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how])
    return out.drop(p["__tx"], p["__ty"]) if how in ("semi", "anti") else out.drop("__tx", "__ty", geom)
