"""Rasters against polygons: labels, rasterisation, zonal statistics.

A polygon becomes candidate cells by exploding the rows and columns of its bounding box, an exact test keeps those it covers, and what follows is an
equi-join on (row, col): no nested loop, whatever the size of the grid. Work is spread by polygon and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..meta import RasterMeta
from .raster import Raster


def candidates(meta: RasterMeta, polygons: DataFrame, geom: str = "geom") -> DataFrame:
    """polygons with every cell (row, col) of their bounding boxes inside the grid."""
    x0, y0, x1, y1 = G.bounds(F.col(geom))
    lo = lambda v: F.greatest(v, F.lit(0))
    rows = polygons.withColumn("__r0", lo(meta.row_of(y1))).withColumn("__r1", F.least(meta.row_of(y0), F.lit(meta.rows - 1)))
    rows = rows.withColumn("__c0", lo(meta.col_of(x0))).withColumn("__c1", F.least(meta.col_of(x1), F.lit(meta.cols - 1)))
    rows = rows.filter((F.col("__r0") <= F.col("__r1")) & (F.col("__c0") <= F.col("__c1")))
    rows = rows.withColumn("row", F.explode(F.sequence("__r0", "__r1")))
    return rows.withColumn("col", F.explode(F.sequence("__c0", "__c1"))).drop("__r0", "__r1", "__c0", "__c1")


def centre_in(meta: RasterMeta, geom: str = "geom") -> Column:
    return G.contains(F.col(geom), meta.x_of(F.col("col")), meta.y_of(F.col("row")))


def touches_box(meta: RasterMeta, geom: str = "geom") -> Column:
    """Whether the open interiors of the cell and of the geometry's bounding box overlap: exact for axis-aligned rectangles."""
    x0, y0, x1, y1 = G.bounds(F.col(geom))
    c, r = F.col("col"), F.col("row")
    return (meta.x_of(c, 0) < x1) & (meta.x_of(c, 1) > x0) & (meta.y_of(r, 1) < y1) & (meta.y_of(r, 0) > y0)


def labels(meta: RasterMeta, polygons: DataFrame, ordinal: str = "zone", geom: str = "geom") -> DataFrame:
    """row, col, zone of the cells whose centre is in a polygon; where they overlap the last (largest ordinal) wins."""
    hit = candidates(meta, polygons.select(ordinal, geom), geom).filter(centre_in(meta, geom))
    return hit.groupBy("row", "col").agg(F.max(ordinal).alias("zone"))


def zonal_stats(raster: Raster, polygons: DataFrame, band: int = 0, overlap: str = "last") -> DataFrame:
    """One row per polygon (column zone): count, sum, mean, min, max, std, var of the cells with data whose centre is inside.

    overlap="last" gives a cell to the last polygon alone, "all" to each. Polygons without data: count and sum 0, others null.
    """
    if overlap == "all":
        where = candidates(raster.meta, polygons.select("zone", "geom")).filter(centre_in(raster.meta)).select("row", "col", "zone")
    else:
        where = labels(raster.meta, polygons)
    v = F.col("value")
    found = raster.band(band).df.filter(v.isNotNull()).join(where, ["row", "col"]).groupBy("zone").agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var")
    )
    return polygons.select("zone").join(found, "zone", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).withColumn("sum", F.coalesce("sum", F.lit(0.0)))


def rasterize(spark, meta: RasterMeta, features: DataFrame, columns: list[str], ordinal: str = "zone", geom: str = "geom", all_touched: bool = True) -> Raster:
    """Burns one band per column; a cell takes the last feature that touches it (all_touched) or covers its centre."""
    test = touches_box(meta, geom) if all_touched else centre_in(meta, geom)
    hit = candidates(meta, features, geom).filter(test)
    burnt = hit.groupBy("row", "col").agg(*(F.max_by(c, ordinal).cast("double").alias(c) for c in columns))
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col(c).alias("value")) for i, c in enumerate(columns, 1)))
    long = burnt.select("row", "col", F.explode(bands).alias("b")).select("b.band", "row", "col", "b.value")
    keys = Raster.lattice(spark, meta, len(columns))
    return Raster(keys.join(long, ["band", "row", "col"], "left").select("band", "row", "col", "value"), meta.with_(bands=len(columns)))


def grid_for(bounds: tuple[float, float, float, float], cell: float, epsg: int = 4326) -> RasterMeta:
    """Grid of a cell size that covers bounds, its upper left corner at theirs."""
    import math

    return RasterMeta(math.ceil((bounds[3] - bounds[1]) / cell), math.ceil((bounds[2] - bounds[0]) / cell), bounds[0], bounds[3], cell, cell, epsg)
