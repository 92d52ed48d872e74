"""Queries of the remaining inventory rows: stores, tables of attributes and colours, reusable plans, variable-wise operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import cf, colors, crs
from ..functions.metadata import Dimension, Metadata
from ..meta import RasterMeta
from ..operators import cluster as C, focal, resample as S, vector as V
from ..operators.cube import Cube
from ..operators.mesh import Mesh
from ..operators.raster import Raster
from ..operators.zonal import zonal_stats
from ..sources import stac, tables
from .base import GRID, Tables, query, rnd
from .cf_queries import items, scratch
from .grid_queries import ALIGN_JOIN, MIRROR, TARGET, two
from .raster_queries import IN_TRIANGLE, cell_rows, triangle

ALL_CELLS = "SELECT r AS \"row\", c AS col, v AS value FROM cells"
CUBE = "SELECT t, r AS \"row\", c AS col, v AS value FROM cube"


def stored_raster(d: Tables):
    to = scratch(d, "store")
    tables.write_raster(d.cells, to)
    return tables.read_raster(d.spark, to)


def stored_cube(d: Tables):
    to = scratch(d, "store")
    tables.write_cube(d.cube, to)
    return tables.read_cube(d.spark, to).df.select("t", "row", "col", "value")


for _name in ("g011_from_store", "g012_read_store", "g044_write_store"):
    query(_name, ALL_CELLS)(lambda d: cell_rows_plain(stored_raster(d)))
for _name in ("g046_collection_to_file", "g062_container_to_file"):
    query(_name, CUBE)(stored_cube)


def cell_rows_plain(x: Raster):
    return x.df.select("row", "col", "value")


@query("g023_arrow_batches", "SELECT vec_id % 10 AS k, COUNT(*) AS n FROM pts GROUP BY 1")
def _(d: Tables):
    def work(batches):
        for b in batches:
            yield b.filter(b.column("vec_id").is_valid())

    p = d.points.select("vec_id").mapInArrow(work, "vec_id long")
    return p.groupBy((F.col("vec_id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("g028_lazy_read", "SELECT COUNT(*) AS n, MIN(x) AS lo FROM pts")
def _(d: Tables):
    return d.points.repartition(4).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"))


@query("g033_mesh_read", "SELECT node_id, x, y FROM nodes")
def _(d: Tables):
    to = scratch(d, "mesh")
    tables.write_mesh(d.mesh, to)
    return tables.read_mesh(d.spark, to).nodes


@query("g060_lazy_to_parquet", "SELECT vec_id, x, y FROM pts")
def _(d: Tables):
    to = scratch(d, "points")
    d.points.select("vec_id", "x", "y").repartition(3).write.parquet(to)
    return d.spark.read.parquet(to)


@query("g092_band_color", "SELECT * FROM (VALUES (1, 'red', 3), (2, 'green', 4), (3, 'blue', 5)) t(band, color, code)")
def _(d: Tables):
    b = d.spark.createDataFrame([(1, "red"), (2, "green"), (3, "blue")], "band int, color string")
    return b.withColumn("code", colors.code_of(F.col("color")))


@query("g094_color_table_rows", "SELECT * FROM (VALUES (1, 0, 255, 0, 0, 255), (1, 1, 0, 255, 0, 128)) t(band, \"values\", red, green, blue, alpha)")
def _(d: Tables):
    p = d.spark.createDataFrame([(0, "#ff0000"), (1, "#00ff0080")], "values int, color string")
    return colors.color_table(p).withColumn("band", F.lit(1))


for _name in ("g096_set_attribute_table", "g155_attribute_lookup"):
    query(_name, "SELECT r AS \"row\", c AS col, 'class ' || k AS label FROM classes WHERE k % 2 = 0")(
        lambda d: d.classes.df.withColumn("code", F.col("value").cast("int")).join(d.spark.range(0, 50, 2).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("class "), F.col("id").cast("string")).alias("label")), "code").select("row", "col", "label")
    )


@query("g130_nearest_neighbour", """
WITH o(k, i, j) AS (VALUES (0, 0, 1), (1, 0, -1), (2, -1, 0), (3, 1, 0), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)),
f AS (SELECT g.r, g.c, min_by(n.v, k) AS found FROM cells g, o JOIN cells n ON n.r = g.r + i AND n.c = g.c + j WHERE g.v IS NULL AND n.v IS NOT NULL GROUP BY 1, 2)
SELECT r AS "row", c AS col, found AS value FROM f
""")
def _(d: Tables):
    return cell_rows_plain(d.cells.fill_gaps(d.dem)).join(d.cells.df.filter("value IS NULL").select("row", "col"), ["row", "col"], "left_semi")


@query("g135_crop_variable", f"SELECT 'a' AS variable, COUNT(v) AS n FROM (SELECT *, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells) WHERE {IN_TRIANGLE} UNION ALL SELECT 'b', COUNT(v) FROM cells")
def _(d: Tables):
    a = Cube.from_raster(d.cells, 1, "a")
    both = a.add(Cube.from_raster(d.cells, 1, "b"))
    cut = both.variable("a").each(lambda x: x.crop_polygons(triangle(d), trim=False))
    return both.remove("a").df.unionByName(cut.df).groupBy("variable").agg(F.count("value").alias("n"))


@query("g138_mesh_clip", "SELECT CAST(COUNT(*) AS BIGINT) AS faces FROM faces WHERE face_id NOT IN (SELECT face_id FROM corners JOIN nodes USING (node_id) WHERE NOT (x >= 0.9 AND x < 4.1 AND y >= 0.9 AND y < 4.1))")
def _(d: Tables):
    return d.mesh.clip([(0.9, 0.9), (4.1, 0.9), (4.1, 4.1), (0.9, 4.1)], touch=False).faces.agg(F.count(F.lit(1)).alias("faces"))


@query("g162_zone_spread", "SELECT zid AS zone, MIN(v) AS \"min\", MAX(v) AS \"max\", ROUND(STDDEV_POP(v), 6) AS std, ROUND(VAR_POP(v), 6) AS var FROM zones LEFT JOIN (SELECT * FROM dem WHERE r >= 10) ON c + 0.5 >= x0 AND c + 0.5 < x1 AND 40 - r - 0.5 >= y0 AND 40 - r - 0.5 < y1 GROUP BY 1")
def _(d: Tables):
    part = d.dem.with_df(d.dem.df.withColumn("value", F.when(F.col("row") >= 10, F.col("value"))))
    return zonal_stats(part, d.zones).select("zone", "min", "max", rnd("std", 6).alias("std"), rnd("var", 6).alias("var"))


@query("g169_groupby_labels", "SELECT CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS \"label\", COUNT(DISTINCT t) AS steps, COUNT(v) AS n FROM cube GROUP BY 1")
def _(d: Tables):
    labels = d.spark.range(1000).select(F.col("id").cast("int").alias("t"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    return d.cube.df.join(labels, "t").groupBy("label").agg(F.count_distinct("t").alias("steps"), F.count("value").alias("n"))


@query("g206_reprojector", "SELECT CAST(COUNT(*) AS BIGINT) AS steps, TRUE AS same FROM range(2)")
def _(d: Tables):
    plan = lambda x: S.to_crs(x, 3857)
    cube = Cube.from_raster(d.cells, 2).each(plan)
    per = cube.df.groupBy("t").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    return per.agg(F.count(F.lit(1)).alias("steps"), (F.count_distinct("n") == 1).alias("same"))


@query("g207_aligner", f"SELECT CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, v AS value FROM range(10) a CROSS JOIN range(12) b LEFT JOIN cells ON {ALIGN_JOIN}")
def _(d: Tables):
    plan = lambda x: S.align(x, TARGET)
    return cell_rows_plain(plan(d.cells))


for _name in ("g212_variables_to_crs", "g214_reproject_variable"):
    query(_name)(lambda d: Cube.from_raster(d.cells, 1, "a").each(lambda x: S.to_crs(x, 3857)).df)


@query("g215_resample_variable", "SELECT 'a' AS variable, COUNT(*) AS n FROM range(320) UNION ALL SELECT 'b', COUNT(*) FROM cells")
def _(d: Tables):
    both = Cube.from_raster(d.cells, 1, "a").add(Cube.from_raster(d.cells, 1, "b"))
    out = both.remove("a").df.unionByName(both.variable("a").each(lambda x: S.resample(x, 2.5)).df)
    return out.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("g225_mesh_to_crs", "SELECT node_id, ROUND(x * (6378137e0 * PI() / 180), 3) AS x, ROUND(6378137e0 * LN(TAN(PI() / 4 + y * PI() / 360)), 3) AS y FROM nodes")
def _(d: Tables):
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    m = Mesh(d.mesh.nodes.select("node_id", x.alias("x"), y.alias("y")), d.mesh.faces)
    return m.nodes.select("node_id", rnd("x", 3).alias("x"), rnd("y", 3).alias("y"))


@query("g256_reproject_points", "SELECT vec_id, ROUND(x * (6378137e0 * PI() / 180), 2) AS px FROM pts")
def _(d: Tables):
    return d.points.select("vec_id", rnd(crs.transform(F.col("x"), F.col("y"), 4326, 3857)[0], 2).alias("px"))


@query("g257_epsg_of_features", "SELECT 32618 AS epsg")
def _(d: Tables):
    return d.spark.createDataFrame([('PROJCS["UTM 18N",AUTHORITY["EPSG","32618"]]',)], "wkt string").select(crs.epsg_of_wkt(F.col("wkt")).alias("epsg"))


@query("g295_coordinate_attrs", "SELECT * FROM (VALUES ('lat', 'axis', 'Y'), ('lat', 'standard_name', 'latitude'), ('lat', 'long_name', 'latitude'), ('lat', 'units', 'degrees_north'), ('time', 'axis', 'T'), ('time', 'standard_name', 'time'), ('time', 'long_name', 'time')) t(dim, attr, value)")
def _(d: Tables):
    return d.spark.createDataFrame([(n, k, v) for n in ("lat", "time", "odd") for k, v in cf.coordinate_attrs(n).items()], "dim string, attr string, value string")


for _name in ("g296_grid_mapping", "g297_from_grid_mapping"):
    query(_name, "SELECT * FROM (VALUES (4326, 'latitude_longitude'), (32633, 'transverse_mercator'), (3035, 'lambert_azimuthal_equal_area'), (3857, 'mercator')) t(epsg, name)")(
        lambda d: d.spark.createDataFrame([(int(g["epsg_code"]), str(g["grid_mapping_name"])) for g in map(cf.grid_mapping, (4326, 32633, 3035, 3857))], "epsg int, name string")
    )


def model() -> Metadata:
    return Metadata("netcdf3", {"title": "x", "source": "y"}, [Dimension("time", 2), Dimension("lat", 3), Dimension("lon", 4)])


for _name in ("g302_dimensions_index", "g303_metadata", "g304_metadata_build", "g307_to_json"):
    query(_name, "SELECT * FROM (VALUES (0, 'time', 2), (1, 'lat', 3), (2, 'lon', 4)) t(ord, name, \"size\")")(
        lambda d: d.spark.createDataFrame([(i, x.name, x.size) for i, x in enumerate(Metadata.from_json(model().to_json()).dimensions)], "ord int, name string, size int")
    )


@query("g310_global_attributes", "SELECT * FROM (VALUES ('title', 'x'), ('source', 'y')) t(name, value)")
def _(d: Tables):
    return d.spark.createDataFrame(list(model().attrs.items()), "name string, value string")


@query("g313_container_from_array", "SELECT CAST(t.range AS INT) AS t, CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, t.range * 12 + a.range * 4 + b.range + 0e0 AS value FROM range(2) t, range(3) a, range(4) b")
def _(d: Tables):
    a = np.arange(24.0).reshape(2, 3, 4)
    cube = Cube.stack([Raster.from_array(d.spark, a[t], RasterMeta(3, 4, y0=3.0)) for t in range(2)])
    return cube.df.select("t", "row", "col", "value")


@query("g321_feature_stream", "SELECT vec_id FROM pts WHERE x BETWEEN 24 AND 26")
def _(d: Tables):
    return V.in_box(d.points.withColumn("geom", F.struct(F.lit("Point").alias("type"), F.array(F.array(F.struct("x", "y"))).alias("parts"))), 24, -1e9, 26, 1e9).select("vec_id")


@query("g331_focal_udaf", MIRROR.format(r=1, n=3) + "SELECT CAST(1 AS INT) AS band, pos.r AS \"row\", pos.c AS col, ROUND(MEDIAN(v), 6) AS value FROM pos JOIN cells s ON s.r = nr AND s.c = nc GROUP BY pos.r, pos.c")
def _(d: Tables):
    return focal.focal_apply(d.cells, lambda w: np.nanmedian(w, axis=1), 1, tile=16).df.select("band", "row", "col", rnd("value", 6).alias("value"))


@query("g332_tile_udf", "SELECT r AS \"row\", c AS col, v * 2 AS value FROM cells")
def _(d: Tables):
    return cell_rows_plain(d.cells.map_blocks(lambda a: a * 2, 16))


@query("g333_preprocess", "SELECT t, r AS \"row\", c AS col, v + 1 AS value FROM cube")
def _(d: Tables):
    to = scratch(d, "one")
    tables.write_cube(d.cube, to)
    return tables.read_cubes(d.spark, [to], d.cube._last() + 1, lambda c: c.unpack(1.0, 1.0)).df.select("t", "row", "col", "value")


@query("g334_patched_href", "SELECT zid AS id, 's3://b/' || lower(name) || '.tif?token=1' AS href FROM zones")
def _(d: Tables):
    return stac.select_items(items(d), "B04", patch=lambda h: F.concat(h, F.lit("?token=1")))


@query("g335_region_outlines", "SELECT CAST(k + 1 AS DOUBLE) AS value, COUNT(*) AS cells, format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {}))', MIN(c), 40 - MIN(r), MAX(c) + 1, 40 - MIN(r), MAX(c) + 1, 39 - MAX(r), MIN(c), 39 - MAX(r), MIN(c), 40 - MIN(r)) AS wkt FROM classes GROUP BY k")
def _(d: Tables):
    x = d.classes.with_df(d.classes.df.withColumn("value", F.col("value") + 1))
    return C.outlines(C.regions(x, tile=16), x).select("value", "cells", "wkt")
