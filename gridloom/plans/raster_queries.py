"""Queries over rasters: access, coordinates, bands, masks, joins with polygons, aggregates. g<NNN> is the number in the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors, geometry as G
from ..meta import RasterMeta
from ..operators.raster import Raster
from ..operators.zonal import labels, rasterize, zonal_stats
from .base import GRID, Tables, query, rnd

r6 = lambda c: rnd(c, 6)
CELL = "CAST(1 AS INT) AS band, r AS \"row\", c AS col"


def cell_rows(x: Raster):
    return x.df.select("row", "col", r6(F.col("value")).alias("value"))


@query("zonal_stats", """
SELECT zid AS zone, name, COUNT(v) AS "count", ROUND(COALESCE(SUM(v), 0), 6) AS "sum", ROUND(AVG(v), 6) AS mean, MIN(v) AS "min", MAX(v) AS "max", ROUND(STDDEV_POP(v), 6) AS std, ROUND(VAR_POP(v), 6) AS var
FROM zones LEFT JOIN cells ON v IS NOT NULL AND c + 0.5 >= x0 AND c + 0.5 < x1 AND 40 - r - 0.5 >= y0 AND 40 - r - 0.5 < y1 GROUP BY 1, 2
""")
def _(d: Tables):
    s = zonal_stats(d.cells, d.zones)
    return s.join(d.zones.select("zone", "name"), "zone").select("zone", "name", "count", r6("sum").alias("sum"), r6("mean").alias("mean"), "min", "max", r6("std").alias("std"), r6("var").alias("var"))


@query("g008_create", "SELECT r AS \"row\", c AS col, CAST(NULL AS DOUBLE) AS value FROM lattice")
def _(d: Tables):
    return Raster.create(d.spark, GRID).df.select("row", "col", "value")


@query("g010_dataset_like", "SELECT r AS \"row\", c AS col, ROUND(v * 2, 6) AS value FROM cells")
def _(d: Tables):
    return cell_rows(d.cells.like(d.cells.df.withColumn("value", F.col("value") * 2)))


@query("g042_ascii_rows", """
SELECT r AS "row", string_agg(COALESCE(printf('%.6f', v), '-9999'), ' ' ORDER BY c) AS line FROM cells GROUP BY 1
""")
def _(d: Tables):
    from ..sources.asciigrid import body_lines

    return body_lines(d.cells, "%.6f")


@query("g043_to_xyz", """
SELECT c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y, MAX(v) FILTER (band = 1) AS "Band_1", MAX(v) FILTER (band = 2) AS "Band_2", MAX(v) FILTER (band = 3) AS "Band_3" FROM cells_mb GROUP BY r, c HAVING COUNT(v) = 3
""")
def _(d: Tables):
    return d.cells_mb.to_xyz()


@query("g066_read_window", "SELECT r - 7 AS \"row\", c - 5 AS col, v AS value FROM cells WHERE c BETWEEN 5 AND 16 AND r BETWEEN 7 AND 15")
def _(d: Tables):
    return d.cells.window(5, 7, 12, 9).df.select("row", "col", "value")


@query("g068_read_block", "SELECT r AS \"row\", c AS col, v AS value FROM cells_mb WHERE band = 2 AND r < 10 AND c < 10")
def _(d: Tables):
    return d.cells_mb.band(1).window(0, 0, 10, 10).df.select("row", "col", "value")


@query("g069_polygon_window", "SELECT 3 AS xoff, 26 AS yoff, 9 AS xsize, 12 AS ysize")
def _(d: Tables):
    return d.spark.createDataFrame([d.cells.polygon_window((3.2, 1.5, 12.7, 13.4))], "xoff int, yoff int, xsize int, ysize int")


@query("g070_write_array", "SELECT r AS \"row\", c AS col, CASE WHEN r BETWEEN 4 AND 6 AND c BETWEEN 8 AND 10 THEN CAST(100 + (r - 4) * 3 + (c - 8) AS DOUBLE) ELSE v END AS value FROM cells")
def _(d: Tables):
    patch = d.spark.range(9).select(F.lit(1).alias("band"), F.expr("CAST(id div 3 AS INT)").alias("row"), (F.col("id") % 3).cast("int").alias("col"), (F.col("id") + 100).cast("double").alias("value"))
    return cell_rows(d.cells.write(patch, 4, 8))


@query("g071_block_arrangement", "SELECT CAST(a.range * 16 AS INT) AS x_offset, CAST(b.range * 12 AS INT) AS y_offset, CAST(LEAST(16, 50 - a.range * 16) AS INT) AS window_xsize, CAST(LEAST(12, 40 - b.range * 12) AS INT) AS window_ysize FROM range(4) a, range(4) b")
def _(d: Tables):
    return d.cells.blocks(16, 12)


@query("g072_tile_offsets", "SELECT CAST(a.range * 16 AS INT) AS x_offset, CAST(b.range * 16 AS INT) AS y_offset, CAST(LEAST(16, 50 - a.range * 16) AS INT) AS window_xsize, CAST(LEAST(16, 40 - b.range * 16) AS INT) AS window_ysize FROM range(4) a, range(3) b")
def _(d: Tables):
    return d.cells.blocks(16, 16)


@query("g073_tiles", "SELECT r // 16 AS tile_row, c // 16 AS tile_col, COUNT(*) AS cells, COUNT(v) AS domain, ROUND(SUM(v), 6) AS total FROM cells GROUP BY 1, 2")
def _(d: Tables):
    return d.cells.tiled(16).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("domain"), r6(F.sum("value")).alias("total"))


for _name in ("g074_lon", "g076_x", "g082_x_dimension"):
    query(_name, "SELECT CAST(range AS INT) AS col, range + 0.5e0 AS x FROM range(50)")(lambda d: d.cells.x_dimension())
for _name in ("g075_lat", "g077_y", "g083_y_dimension"):
    query(_name, "SELECT CAST(range AS INT) AS \"row\", 40 - (range + 0.5e0) AS y FROM range(40)")(lambda d: d.cells.y_dimension())


@query("g078_bbox", "SELECT 0e0 AS xmin, 0e0 AS ymin, 50e0 AS xmax, 40e0 AS ymax")
def _(d: Tables):
    return d.cells.bounds().drop("wkt")


@query("g079_bounds", "SELECT 'POLYGON ((0 0, 0 40, 50 40, 50 0, 0 0))' AS wkt")
def _(d: Tables):
    return d.cells.bounds().select("wkt")


@query("g080_total_bounds", "SELECT MIN(c) + 0e0 AS xmin, 40 - MAX(r) - 1e0 AS ymin, MAX(c) + 1e0 AS xmax, 40 - MIN(r) + 0e0 AS ymax FROM lattice")
def _(d: Tables):
    m = GRID
    return d.cells.df.agg(F.min(m.x_of(F.col("col"), 0)).alias("xmin"), F.min(m.y_of(F.col("row"), 1)).alias("ymin"), F.max(m.x_of(F.col("col"), 1)).alias("xmax"), F.max(m.y_of(F.col("row"), 0)).alias("ymax"))


@query("g084_cell_coords", "SELECT r AS \"row\", c AS col, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells WHERE v IS NOT NULL")
def _(d: Tables):
    return d.cells.coords(domain_only=True)


@query("g084_cell_corners", "SELECT r AS \"row\", c AS col, c + 0e0 AS x, 40 - r + 0e0 AS y FROM cells")
def _(d: Tables):
    return d.cells.coords("corner")


@query("g085_cell_points", "SELECT CAST(r * 50 + c AS BIGINT) AS id, 'POINT (' || c || '.5 ' || (39 - r) || '.5)' AS wkt FROM cells WHERE v IS NOT NULL")
def _(d: Tables):
    return d.cells.points(domain_only=True).select("id", "wkt")


@query("g086_cell_polygons", "SELECT CAST(r * 50 + c AS BIGINT) AS id, format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {}))', c, 40 - r, c + 1, 40 - r, c + 1, 39 - r, c, 39 - r, c, 40 - r) AS wkt FROM cells")
def _(d: Tables):
    return d.cells.polygons().select("id", "wkt")


@query("g087_map_to_array", "SELECT vec_id, CAST(LEAST(GREATEST(FLOOR(40 - y), 0), 39) AS INT) AS \"row\", CAST(LEAST(GREATEST(FLOOR(x), 0), 49) AS INT) AS col FROM pts")
def _(d: Tables):
    return d.cells.locate(d.points).select("vec_id", "row", "col")


@query("g088_array_to_map", "SELECT r AS \"row\", c AS col, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM lattice WHERE (r + c) % 7 = 0")
def _(d: Tables):
    cells = d.cells.df.select("row", "col").filter((F.col("row") + F.col("col")) % 7 == 0)
    return d.cells.map_coordinates(cells, center=True)


@query("g089_add_band", "SELECT CAST(1 AS INT) AS band, r AS \"row\", c AS col, v AS value FROM cells UNION ALL SELECT 2, r, c, CAST(k AS DOUBLE) FROM classes")
def _(d: Tables):
    return d.cells.add_band(d.classes.df).df


@query("g090_iloc", "SELECT r AS \"row\", c AS col, v AS value FROM cells_mb WHERE band = 3")
def _(d: Tables):
    return cell_rows(d.cells_mb.band(2))


@query("g091_band_by_color", "SELECT 2 AS band")
def _(d: Tables):
    bands = d.spark.createDataFrame([(1, "red"), (2, "green"), (3, "blue"), (4, "green")], "band int, color string")
    return bands.filter(F.col("color") == "green").agg(F.min("band").alias("band"))


PALETTE = [(0, "#112233"), (10, "#ff8800"), (20, "#00ff00"), (30, "#0000ff80"), (40, "#ABCDEF")]


@query("g093_color_table", """
WITH p(k, h) AS (VALUES (0, '112233'), (10, 'ff8800'), (20, '00ff00'), (30, '0000ff80'), (40, 'ABCDEF'))
SELECT k AS "values", CAST('0x' || substr(h, 1, 2) AS INT) AS red, CAST('0x' || substr(h, 3, 2) AS INT) AS green, CAST('0x' || substr(h, 5, 2) AS INT) AS blue, CASE WHEN length(h) > 6 THEN CAST('0x' || substr(h, 7, 2) AS INT) ELSE 255 END AS alpha, COUNT(c.k1) AS cells
FROM p LEFT JOIN (SELECT k AS k1 FROM classes) c ON k1 = k GROUP BY ALL
""")
def _(d: Tables):
    p = colors.color_table(d.spark.createDataFrame(PALETTE, "values int, color string"))
    n = d.classes.df.groupBy(F.col("value").cast("int").alias("values")).agg(F.count(F.lit(1)).alias("cells"))
    return p.join(n, "values", "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))


@query("g337_process_color_table", "SELECT * FROM (VALUES (1, 255, 136, 0, 255), (2, 1, 2, 3, 4)) t(\"values\", red, green, blue, alpha)")
def _(d: Tables):
    return colors.color_table(d.spark.createDataFrame([(1, "#FF8800"), (2, "#01020304")], "values int, color string"))


@query("g095_attribute_table", "SELECT k AS value, 'class ' || k AS label, COUNT(*) AS cells FROM classes GROUP BY 1, 2")
def _(d: Tables):
    table = d.spark.range(0, 50).select(F.col("id").cast("int").alias("value"), F.concat(F.lit("class "), F.col("id").cast("string")).alias("label"))
    c = d.classes.df.groupBy(F.col("value").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("cells"))
    return c.join(table, "value").select("value", "label", "cells")


@query("g097_band_names", "SELECT * FROM (VALUES (1, 'red'), (2, 'nir'), (3, 'Band_3')) t(band, name)")
def _(d: Tables):
    said = d.spark.createDataFrame([(1, "red", None), (2, None, "nir"), (3, None, None)], "band int, description string, entry string")
    return d.cells_mb.band_names(said)


@query("g098_translate", "SELECT CAST(CASE band WHEN 3 THEN 1 ELSE 2 END AS INT) AS band, r - 10 AS \"row\", c - 5 AS col, ROUND(0e0 + (v - 0e0) * (255e0 / 50e0), 6) AS value FROM cells_mb WHERE band IN (1, 3) AND r BETWEEN 10 AND 19 AND c BETWEEN 5 AND 24")
def _(d: Tables):
    x = d.cells_mb.translate(bands=[3, 1], window=(5, 10, 20, 10), scale=(0, 50, 0, 255))
    return x.df.withColumn("value", r6("value"))


@query("g117_mask", "SELECT r AS \"row\", c AS col, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS mask FROM cells")
def _(d: Tables):
    return d.cells.mask()


@query("g118_count_domain", "SELECT CAST(band AS INT) AS band, COUNT(v) AS cells FROM cells_mb GROUP BY 1")
def _(d: Tables):
    return d.cells_mb.count_domain()


@query("g119_extract", "SELECT r AS \"row\", c AS col, v AS value FROM cells WHERE v IS NOT NULL AND ABS(v - 25.5) > 1e-8 + 1e-3 * 25.5")
def _(d: Tables):
    return d.cells.extract(25.5).select("row", "col", "value")


@query("g119_extract_points", "SELECT vec_id, r AS \"row\", c AS col, v AS value FROM pts JOIN cells ON c = FLOOR(x) AND r = FLOOR(40 - y)")
def _(d: Tables):
    return d.cells.extract_points(d.points).select("vec_id", "row", "col", "value")


@query("g120_fill", "SELECT r AS \"row\", c AS col, CASE WHEN v IS NOT NULL THEN 7e0 END AS value FROM cells")
def _(d: Tables):
    return cell_rows(d.cells.fill(7))


@query("g121_change_nodata", "SELECT r AS \"row\", c AS col, COALESCE(v, -1) AS value FROM cells")
def _(d: Tables):
    return d.cells.change_nodata(d.cells.to_sentinel(), -9999.0, -1.0).select("row", "col", "value")


TRIANGLE = [(5.0, 5.0), (30.0, 8.0), (18.0, 33.0)]
IN_TRIANGLE = "((8e0-5e0)*(x-5e0)-(30e0-5e0)*(y-5e0) < 0) AND ((33e0-8e0)*(x-30e0)-(18e0-30e0)*(y-8e0) < 0) AND ((5e0-33e0)*(x-18e0)-(5e0-18e0)*(y-33e0) < 0)"


def triangle(d: Tables):
    ring = F.array(*(G.xy(F.lit(x), F.lit(y)) for x, y in TRIANGLE))
    return d.spark.range(1).select(F.lit(0).alias("zone"), G.polygon(G.close(ring)).alias("geom"))


@query("g124_crop", f"""
WITH p AS (SELECT r, c, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y, v FROM cells), i AS (SELECT *, {IN_TRIANGLE} AS inside FROM p),
e AS (SELECT MIN(r) r0, MAX(r) r1, MIN(c) c0, MAX(c) c1 FROM i WHERE inside AND v IS NOT NULL)
SELECT r - r0 AS "row", c - c0 AS col, CASE WHEN inside THEN v END AS value FROM i, e WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1
""")
def _(d: Tables):
    return cell_rows(d.cells.crop_polygons(triangle(d)))


@query("g125_crop_polygon_keep_extent", f"SELECT r AS \"row\", c AS col, CASE WHEN {IN_TRIANGLE} THEN v END AS value FROM (SELECT *, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells)")
def _(d: Tables):
    return cell_rows(d.cells.crop_polygons(triangle(d), trim=False))


@query("g126_crop_raster", "SELECT r AS \"row\", c AS col, CASE WHEN k >= 20 THEN v END AS value FROM cells JOIN classes USING (r, c)")
def _(d: Tables):
    mask = d.classes.with_df(d.classes.df.withColumn("value", F.when(F.col("value") >= 20, F.col("value"))))
    return cell_rows(d.cells.crop_raster(mask))


@query("g127_crop_aligned", "SELECT r AS \"row\", c AS col, CASE WHEN c.v IS NOT NULL THEN m.v END AS value FROM dem m JOIN cells c USING (r, c)")
def _(d: Tables):
    return cell_rows(d.dem.crop_raster(d.cells))


@query("g128_drop_empty_lines", "SELECT DENSE_RANK() OVER (ORDER BY r) - 1 AS \"row\", DENSE_RANK() OVER (ORDER BY c) - 1 AS col, v AS value FROM cells WHERE r % 5 <> 2 AND c % 9 <> 4")
def _(d: Tables):
    holed = d.cells.with_df(d.cells.df.withColumn("value", F.when((F.col("row") % 5 != 2) & (F.col("col") % 9 != 4), F.col("value"))))
    return holed.drop_empty_lines().select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


NEAR8 = "[(0, 1), (0, -1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]"


@query("g129_fill_gaps", """
WITH o(k, i, j) AS (VALUES (0, 0, 1), (1, 0, -1), (2, -1, 0), (3, 1, 0), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)),
f AS (SELECT g.r, g.c, min_by(n.v, k) AS found FROM cells g, o JOIN cells n ON n.r = g.r + i AND n.c = g.c + j WHERE g.v IS NULL AND n.v IS NOT NULL GROUP BY 1, 2)
SELECT r AS "row", c AS col, COALESCE(v, found) AS value FROM cells LEFT JOIN f USING (r, c)
""")
def _(d: Tables):
    return cell_rows(d.cells.fill_gaps(d.dem))


@query("g144_zonal_stats_all", """
SELECT zid AS zone, COUNT(v) AS "count", ROUND(AVG(v), 6) AS mean FROM (SELECT zid, x0 - 3 AS x0, x1 + 3 AS x1, y0 - 3 AS y0, y1 + 3 AS y1 FROM zones) LEFT JOIN cells ON v IS NOT NULL AND c + 0.5 >= x0 AND c + 0.5 < x1 AND 40 - r - 0.5 >= y0 AND 40 - r - 0.5 < y1 GROUP BY 1
""")
def _(d: Tables):
    wide = d.zones.withColumn("geom", G.box(F.col("x0") - 3, F.col("y0") - 3, F.col("x1") + 3, F.col("y1") + 3))
    return zonal_stats(d.cells, wide, overlap="all").select("zone", "count", r6("mean").alias("mean"))


@query("g145_rasterize_labels", "SELECT r AS \"row\", c AS col, MAX(zid) AS zone FROM cells JOIN zones ON c + 0.5 >= x0 - 3 AND c + 0.5 < x1 + 3 AND 40 - r - 0.5 >= y0 - 3 AND 40 - r - 0.5 < y1 + 3 GROUP BY 1, 2")
def _(d: Tables):
    wide = d.zones.withColumn("geom", G.box(F.col("x0") - 3, F.col("y0") - 3, F.col("x1") + 3, F.col("y1") + 3))
    return labels(GRID, wide)


@query("g146_from_features", """
WITH h AS (SELECT r, c, max_by(zid, zid) AS a, max_by(zid * 2 + 1, zid) AS b FROM lattice JOIN zones ON c < x1 + 0.25 AND c + 1 > x0 + 0.25 AND 39 - r < y1 + 0.25 AND 40 - r > y0 + 0.25 WHERE zid % 2 = 0 GROUP BY 1, 2),
t AS (SELECT l.r, l.c, a, b FROM lattice l LEFT JOIN h USING (r, c))
SELECT 1 AS band, r AS "row", c AS col, CAST(a AS DOUBLE) AS value FROM t UNION ALL SELECT 2, r, c, CAST(b AS DOUBLE) FROM t
""")
def _(d: Tables):
    z = d.zones.filter(F.col("zone") % 2 == 0).withColumn("geom", G.box(F.col("x0") + 0.25, F.col("y0") + 0.25, F.col("x1") + 0.25, F.col("y1") + 0.25))
    return rasterize(d.spark, GRID, z.withColumn("a", F.col("zone")).withColumn("b", F.col("zone") * 2 + 1).select("zone", "geom", "a", "b"), ["a", "b"]).df


@query("g147_overlay", "SELECT CAST(k AS BIGINT) AS class, list_sort(list(v)) AS \"values\" FROM cells JOIN classes USING (r, c) WHERE v IS NOT NULL GROUP BY 1")
def _(d: Tables):
    return d.cells.overlay(d.classes).groupBy("class").agg(F.sort_array(F.collect_list("value")).alias("values"))


@query("g147_overlay_stats", "SELECT CAST(k AS BIGINT) AS class, COUNT(v) AS n, ROUND(AVG(v), 6) AS mean FROM cells JOIN classes USING (r, c) WHERE v IS NOT NULL GROUP BY 1")
def _(d: Tables):
    return d.cells.overlay(d.classes).groupBy("class").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"))


@query("g149_check_alignment", "SELECT TRUE AS same, FALSE AS other")
def _(d: Tables):
    return d.spark.createDataFrame([(GRID.same_grid(d.dem.meta), GRID.same_grid(RasterMeta(40, 50, x0=1.0)))], "same boolean, other boolean")


@query("g156_stats", "SELECT CAST(band AS INT) AS band, MIN(v) AS \"min\", MAX(v) AS \"max\", ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_POP(v), 6) AS std FROM cells_mb GROUP BY 1")
def _(d: Tables):
    return d.cells_mb.stats().select("band", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"))


@query("g156_stats_masked", f"SELECT CAST(1 AS INT) AS band, MIN(v) AS \"min\", MAX(v) AS \"max\", ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_POP(v), 6) AS std FROM (SELECT *, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells) WHERE {IN_TRIANGLE}")
def _(d: Tables):
    return d.cells.stats(triangle(d)).select("band", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"))


@query("g158_histogram", """
WITH e AS (SELECT MIN(v) lo, MAX(v) hi FROM cells), n AS (SELECT CAST(FLOOR((v - lo) * 6 / (hi - lo)) AS INT) AS b, COUNT(*) AS n FROM cells, e WHERE v IS NOT NULL GROUP BY 1)
SELECT CAST(range AS INT) AS bin, ROUND(lo + range * (hi - lo) / 6, 6) AS "lower", ROUND(lo + (range + 1) * (hi - lo) / 6, 6) AS "upper", COALESCE(n, 0) AS "count" FROM range(6) CROSS JOIN e LEFT JOIN n ON b = range
""")
def _(d: Tables):
    return d.cells.histogram().select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")


@query("g158_histogram_clamped", """
WITH n AS (SELECT LEAST(GREATEST(CAST(FLOOR((v - 20) * 5 / 10) AS INT), 0), 4) AS b, COUNT(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY 1)
SELECT CAST(range AS INT) AS bin, 20 + range * 2e0 AS "lower", 20 + (range + 1) * 2e0 AS "upper", COALESCE(n, 0) AS "count" FROM range(5) LEFT JOIN n ON b = range
""")
def _(d: Tables):
    return d.cells.histogram(5, 20, 30, include_out_of_range=True)


@query("g159_normalize", "SELECT r AS \"row\", c AS col, ROUND((v - MIN(v) OVER ()) / (MAX(v) OVER () - MIN(v) OVER ()), 6) AS value FROM cells")
def _(d: Tables):
    return cell_rows(d.cells.normalize())


@query("g160_rescale", "SELECT r AS \"row\", c AS col, ROUND((v - 10) / 40, 6) AS value FROM cells")
def _(d: Tables):
    return cell_rows(d.cells.rescale(10, 50))


@query("g161_zone_counts_empty", "SELECT zid AS zone, COUNT(v) AS \"count\", ROUND(COALESCE(SUM(v), 0), 6) AS \"sum\" FROM zones LEFT JOIN (SELECT * FROM cells WHERE r < 20) ON v IS NOT NULL AND c + 0.5 >= x0 AND c + 0.5 < x1 AND 40 - r - 0.5 >= y0 AND 40 - r - 0.5 < y1 GROUP BY 1")
def _(d: Tables):
    half = d.cells.with_df(d.cells.df.withColumn("value", F.when(F.col("row") < 20, F.col("value"))))
    return zonal_stats(half, d.zones).select("zone", "count", r6("sum").alias("sum"))


@query("g246_to_features", "SELECT r AS \"row\", c AS col, MAX(v) FILTER (band = 1) AS \"Band_1\", MAX(v) FILTER (band = 2) AS \"Band_2\", MAX(v) FILTER (band = 3) AS \"Band_3\", 'POINT (' || c || '.5 ' || (39 - r) || '.5)' AS wkt FROM cells_mb GROUP BY r, c HAVING COUNT(v) = 3")
def _(d: Tables):
    return d.cells_mb.to_features(geometry="point")


@query("g248_extract_values_full", "SELECT r AS \"row\", c AS col, v AS \"Band_1\" FROM cells WHERE v IS NOT NULL")
def _(d: Tables):
    return d.cells.to_features()


@query("g009_create_from_array", "SELECT a.range * 10 + b.range + 0e0 AS value, CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col FROM range(10) a, range(10) b")
def _(d: Tables):
    import numpy as np

    return Raster.from_array(d.spark, np.arange(100.0).reshape(10, 10), RasterMeta(10, 10, y0=10.0)).df.select("row", "col", "value")


@query("g329_apply", "SELECT r AS \"row\", c AS col, ROUND(v * v + 1, 6) AS value FROM cells")
def _(d: Tables):
    return cell_rows(d.cells.apply(lambda a: a * a + 1))


@query("g199_map_blocks", "SELECT r AS \"row\", c AS col, ROUND(v - MIN(v) OVER (PARTITION BY r // 16, c // 16), 6) AS value FROM cells")
def _(d: Tables):
    import numpy as np

    return cell_rows(d.cells.map_blocks(lambda a: a - np.nanmin(a), 16))
