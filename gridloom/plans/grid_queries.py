"""Queries over neighbourhoods, resampling, time stacks and regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import crs
from ..meta import RasterMeta
from ..operators import cluster as C, focal, resample as S
from ..operators.cube import Cube
from ..operators.raster import Raster
from .base import GRID, Tables, query, rnd
from .raster_queries import cell_rows, r6, triangle, IN_TRIANGLE

MIRROR = """
WITH o AS (SELECT a.range - {r} AS i, b.range - {r} AS j FROM range({n}) a, range({n}) b),
pos AS (SELECT r, c, CASE WHEN r + i < 0 THEN -1 - r - i WHEN r + i > 39 THEN 79 - r - i ELSE r + i END AS nr, CASE WHEN c + j < 0 THEN -1 - c - j WHEN c + j > 49 THEN 99 - c - j ELSE c + j END AS nc FROM lattice, o),
m1 AS (SELECT pos.r, pos.c, AVG(v) AS m FROM pos JOIN cells s ON s.r = nr AND s.c = nc GROUP BY 1, 2)
"""


@query("g186_focal_mean", MIRROR.format(r=2, n=5) + "SELECT r AS \"row\", c AS col, ROUND(m, 6) AS value FROM m1")
def _(d: Tables):
    return cell_rows(focal.focal_mean(d.cells, 2))


@query("g187_focal_std", MIRROR.format(r=1, n=3) + """, dev AS (SELECT r, c, (v - m) * (v - m) AS q FROM cells JOIN m1 USING (r, c))
SELECT pos.r AS "row", pos.c AS col, ROUND(SQRT(AVG(q)), 5) AS value FROM pos JOIN dev s ON s.r = nr AND s.c = nc GROUP BY 1, 2""")
def _(d: Tables):
    return focal.focal_std(d.cells, 1).df.select("row", "col", rnd("value", 5).alias("value"))


@query("g188_focal_apply", MIRROR.format(r=1, n=3) + "SELECT pos.r AS \"row\", pos.c AS col, MAX(v) AS value FROM pos JOIN cells s ON s.r = nr AND s.c = nc GROUP BY 1, 2")
def _(d: Tables):
    return focal.focal_apply(d.cells, lambda w: np.nanmax(w, axis=1), 1, tile=16).df.select("row", "col", "value")


GRAD = """
WITH g AS (SELECT r, c, v,
  CASE WHEN c = 0 THEN LEAD(v) OVER x - v WHEN c = 49 THEN v - LAG(v) OVER x ELSE (LEAD(v) OVER x - LAG(v) OVER x) / 2 END AS gx,
  CASE WHEN r = 0 THEN LEAD(v) OVER y - v WHEN r = 39 THEN v - LAG(v) OVER y ELSE (LEAD(v) OVER y - LAG(v) OVER y) / 2 END AS gy
  FROM dem WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r))
"""


@query("g189_gradient", GRAD + "SELECT r AS \"row\", c AS col, ROUND(gx, 6) AS gx, ROUND(gy, 6) AS gy FROM g")
def _(d: Tables):
    return focal.gradient(d.dem).select("row", "col", r6("gx").alias("gx"), r6("gy").alias("gy"))


@query("g190_slope", GRAD + "SELECT r AS \"row\", c AS col, ROUND(DEGREES(ATAN(SQRT(gx * gx + gy * gy))), 5) AS value FROM g")
def _(d: Tables):
    return focal.slope(d.dem).df.select("row", "col", rnd("value", 5).alias("value"))


@query("g191_aspect", GRAD + "SELECT r AS \"row\", c AS col, ROUND(fmod(450e0 - DEGREES(ATAN2(gy, -gx)), 360e0), 5) AS value FROM g")
def _(d: Tables):
    return focal.aspect(d.dem).df.select("row", "col", rnd("value", 5).alias("value"))


@query("g192_hillshade", GRAD + "SELECT r AS \"row\", c AS col, ROUND(LEAST(GREATEST(255 * (SIN(RADIANS(45e0)) * COS(ATAN(SQRT(gx * gx + gy * gy))) + COS(RADIANS(45e0)) * SIN(ATAN(SQRT(gx * gx + gy * gy))) * COS(RADIANS(135e0) - ATAN2(gy, -gx))), 0), 255), 5) AS value FROM g")
def _(d: Tables):
    return focal.hillshade(d.dem).df.select("row", "col", rnd("value", 5).alias("value"))


CLUSTER_SQL = """
WITH RECURSIVE sel AS (SELECT r, c, v, r * 50 + c AS id FROM cells WHERE v BETWEEN 27 AND 60),
reach(id, root) AS (SELECT id, id FROM sel UNION SELECT n.id, x.root FROM reach x JOIN sel s ON s.id = x.id JOIN sel n ON ABS(n.r - s.r) <= 1 AND ABS(n.c - s.c) <= 1),
lab AS (SELECT id, MIN(root) AS label FROM reach GROUP BY 1)
SELECT r AS "row", c AS col, v AS value, CAST(DENSE_RANK() OVER (ORDER BY label) AS INT) AS cluster FROM sel JOIN lab USING (id)
"""


@query("g194_cluster", CLUSTER_SQL)
def _(d: Tables):
    return C.cluster(d.cells, 27, 60, tile=16)


BOX = "format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {}))', MIN(c), 40 - MIN(r), MAX(c) + 1, 40 - MIN(r), MAX(c) + 1, 39 - MAX(r), MIN(c), 39 - MAX(r), MIN(c), 40 - MIN(r)) AS wkt"


@query("g196_polygonize", f"SELECT CAST(MIN(r * 50 + c) AS BIGINT) AS \"label\", CAST(k + 1 AS DOUBLE) AS value, COUNT(*) AS cells, {BOX} FROM classes GROUP BY k")
def _(d: Tables):
    x = d.classes.with_df(d.classes.df.withColumn("value", F.col("value") + 1))
    return C.outlines(C.regions(x, tile=16), x)


@query("g198_footprint", f"SELECT CAST(MIN(r * 50 + c) AS BIGINT) AS \"label\", 2e0 AS value, COUNT(*) AS cells, {BOX} FROM classes WHERE k % 20 < 10 GROUP BY r // 8")
def _(d: Tables):
    holed = d.classes.with_df(d.classes.df.withColumn("value", F.when(F.col("value") % 20 < 10, F.col("value"))))
    return C.footprint(holed, tile=16)


@query("g200_resample_nearest", "SELECT CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, v AS value FROM range(16) a CROSS JOIN range(20) b LEFT JOIN cells ON r = FLOOR((a.range + 0.5e0) * 2.5e0) AND c = FLOOR((b.range + 0.5e0) * 2.5e0)")
def _(d: Tables):
    return S.resample(d.cells, 2.5).df.select("row", "col", "value")


@query("g200_resample_bilinear", """
WITH t AS (SELECT a.range AS tr, b.range AS tc, (a.range + 0.5e0) * 0.8e0 - 0.5e0 AS fy, (b.range + 0.5e0) * 0.8e0 - 0.5e0 AS fx FROM range(50) a, range(62) b),
w AS (SELECT tr, tc, v, (1 - ABS(fy - r)) * (1 - ABS(fx - c)) AS w FROM t JOIN dem ON r BETWEEN FLOOR(fy) AND FLOOR(fy) + 1 AND c BETWEEN FLOOR(fx) AND FLOOR(fx) + 1)
SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, ROUND(SUM(w * v) / SUM(w), 5) AS value FROM w GROUP BY 1, 2
""")
def _(d: Tables):
    return S.resample(d.dem, 0.8, "bilinear").df.select("row", "col", rnd("value", 5).alias("value"))


@query("g200_resample_cubic", """
WITH t AS (SELECT a.range AS tr, b.range AS tc, (a.range + 0.5e0) * 0.8e0 - 0.5e0 AS fy, (b.range + 0.5e0) * 0.8e0 - 0.5e0 AS fx FROM range(50) a, range(62) b),
p AS (SELECT tr, tc, v, ABS(fy - r) AS a, ABS(fx - c) AS b FROM t JOIN dem ON r BETWEEN FLOOR(fy) - 1 AND FLOOR(fy) + 2 AND c BETWEEN FLOOR(fx) - 1 AND FLOOR(fx) + 2),
w AS (SELECT tr, tc, v, (CASE WHEN a <= 1 THEN (1.5e0 * a - 2.5e0) * a * a + 1 WHEN a < 2 THEN ((-0.5e0 * a + 2.5e0) * a - 4) * a + 2 ELSE 0 END) * (CASE WHEN b <= 1 THEN (1.5e0 * b - 2.5e0) * b * b + 1 WHEN b < 2 THEN ((-0.5e0 * b + 2.5e0) * b - 4) * b + 2 ELSE 0 END) AS w FROM p)
SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, ROUND(SUM(w * v) / SUM(w), 5) AS value FROM w GROUP BY 1, 2
""")
def _(d: Tables):
    return S.resample(d.dem, 0.8, "cubic").df.select("row", "col", rnd("value", 5).alias("value"))


TARGET = RasterMeta(10, 12, x0=4.25, y0=33.5, dx=2.0, dy=2.0)
ALIGN_JOIN = "r = FLOOR(40e0 - (33.5e0 - (a.range + 0.5e0) * 2)) AND c = FLOOR(4.25e0 + (b.range + 0.5e0) * 2)"


@query("g203_align", f"SELECT CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, v AS value FROM range(10) a CROSS JOIN range(12) b LEFT JOIN cells ON {ALIGN_JOIN}")
def _(d: Tables):
    return S.align(d.cells, TARGET).df.select("row", "col", "value")


@query("g204_convert_longitude", "SELECT r AS \"row\", (c + 25) % 50 AS col, v AS value FROM cells")
def _(d: Tables):
    wide = Raster(d.cells.df, GRID.with_(dx=7.2))
    return S.convert_longitude(wide).df.select("row", "col", "value")


MERC = "20037508.342789244e0 / 180"


@query("g201_to_crs")
def _(d: Tables):
    return S.to_crs(d.cells, 3857).df


@query("g202_reproject_bilinear")
def _(d: Tables):
    return S.to_crs(d.dem, 32631, "bilinear", keep_shape=True).df


@query("g226_reproject_coordinates", "SELECT vec_id, ROUND(x * (6378137e0 * PI() / 180), 3) AS px, ROUND(6378137e0 * LN(TAN(PI() / 4 + y * PI() / 360)), 3) AS py FROM pts")
def _(d: Tables):
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    return d.points.select("vec_id", rnd(x, 3).alias("px"), rnd(y, 3).alias("py"))


@query("g226_reproject_round_trip", "SELECT vec_id, ROUND(x, 6) AS utm_x, ROUND(y, 6) AS utm_y, ROUND(x, 6) AS laea_x, ROUND(y, 6) AS laea_y FROM pts")
def _(d: Tables):
    x, y = F.col("x"), F.col("y")
    ux, uy = crs.inverse(*crs.forward(x, y, 32635), 32635)
    lx, ly = crs.inverse(*crs.forward(x, y, 3035), 3035)
    return d.points.select("vec_id", *(rnd(c, 6).alias(n) for c, n in ((ux, "utm_x"), (uy, "utm_y"), (lx, "laea_x"), (ly, "laea_y"))))


@query("g227_epsg_of_wkt", "SELECT 'GEOGCS[\"a\",AUTHORITY[\"EPSG\",\"6326\"],AUTHORITY[\"EPSG\",\"4326\"]]' AS wkt, 4326 AS epsg UNION ALL SELECT 'LOCAL_CS[\"b\"]', NULL")
def _(d: Tables):
    w = d.spark.createDataFrame([('GEOGCS["a",AUTHORITY["EPSG","6326"],AUTHORITY["EPSG","4326"]]',), ('LOCAL_CS["b"]',)], "wkt string")
    return w.select("wkt", crs.epsg_of_wkt(F.col("wkt")).alias("epsg"))


@query("g229_auto_zoom", "SELECT zid, CAST(LEAST(GREATEST(CEIL(LOG2(360e0 / GREATEST(x1 - x0 - zid * 0.3e0, y1 - y0))), 0), 19) AS INT) AS zoom FROM zones")
def _(d: Tables):
    return d.zones.select(F.col("zone").alias("zid"), crs.auto_zoom(F.col("x0"), F.col("y0"), F.col("x1") - F.col("zone") * F.lit(0.3), F.col("y1")).alias("zoom"))


@query("g234_densified_bounds")
def _(d: Tables):
    return d.spark.createDataFrame([crs.project_bounds((5.0, 45.0, 15.0, 55.0), 4326, 3035)], "xmin double, ymin double, xmax double, ymax double")


@query("g217_overview_nearest", "SELECT r // 4 AS \"row\", c // 4 AS col, arg_min(COALESCE(v, -1), r * 50 + c) AS value FROM cells GROUP BY 1, 2")
def _(d: Tables):
    return S.overview(d.cells, 4).df.select("row", "col", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("g217_overview_average", "SELECT r // 4 AS \"row\", c // 4 AS col, ROUND(AVG(v), 6) AS value FROM cells WHERE v IS NOT NULL GROUP BY 1, 2")
def _(d: Tables):
    return cell_rows(S.overview(d.cells, 4, "average"))


@query("g217_overview_rms", "SELECT r // 8 AS \"row\", c // 8 AS col, ROUND(SQRT(AVG(v * v)), 6) AS value FROM cells WHERE v IS NOT NULL GROUP BY 1, 2")
def _(d: Tables):
    return cell_rows(S.overview(d.cells, 8, "rms"))


@query("g217_overview_mode", """
WITH n AS (SELECT r // 16 AS a, c // 16 AS b, k, COUNT(*) AS n FROM classes GROUP BY ALL)
SELECT a AS "row", b AS col, CAST(arg_min(k, -n * 1000 + k) AS DOUBLE) AS value FROM n GROUP BY 1, 2
""")
def _(d: Tables):
    return S.overview(d.classes, 16, "mode").df.select("row", "col", "value")


@query("g220_read_overview", "SELECT r // 2 AS \"row\", c // 2 AS col, MAX(v) AS value FROM dem GROUP BY 1, 2")
def _(d: Tables):
    return S.overviews(d.dem, [2, 4], "max").filter("level = 2").select("row", "col", "value")


@query("g211_merge", "SELECT r AS \"row\", c AS col, CASE WHEN c >= 20 AND v IS NOT NULL THEN v * 10 WHEN c < 30 THEN k END AS value FROM cells JOIN classes USING (r, c)")
def _(d: Tables):
    left = Raster(d.classes.df.filter("col < 30"), GRID.with_(cols=30))
    right = Raster(d.cells.df.filter("col >= 20").select("band", "row", (F.col("col") - 20).alias("col"), (F.col("value") * 10).alias("value")), GRID.with_(cols=30, x0=20.0))
    return S.mosaic([left, right]).df.select("row", "col", "value")


# -- time stacks ------------------------------------------------------------------------------------------------------------------

CUBE_CELL = "r AS \"row\", c AS col"

for _how, _sql in (("mean", "AVG(v)"), ("sum", "SUM(v)"), ("min", "MIN(v)"), ("max", "MAX(v)"), ("std", "STDDEV_POP(v)"), ("var", "VAR_POP(v)")):
    _n = {"mean": 163, "sum": 164, "min": 165, "max": 166, "std": 167, "var": 168}[_how]
    query(f"g{_n}_time_{_how}", f"SELECT {CUBE_CELL}, ROUND({_sql}, 5) AS value FROM cube GROUP BY 1, 2")(lambda d, how=_how: d.cube.reduce(how).select("row", "col", rnd("value", 5).alias("value")))
    query(f"g{_n + 7}_grouped_{_how}", f"SELECT t // 7 AS \"label\", {CUBE_CELL}, ROUND({_sql}, 5) AS value FROM cube GROUP BY 1, 2, 3")(
        lambda d, how=_how: d.cube.groupby(d.spark.range(1000).select(F.col("id").cast("int").alias("t"), F.expr("CAST(id div 7 AS INT)").alias("label")), how).select("label", "row", "col", rnd("value", 5).alias("value"))
    )


@query("g163_time_mean_strict", "SELECT r AS \"row\", c AS col, CASE WHEN COUNT(v) = 3 THEN ROUND(AVG(v), 6) END AS value FROM cells_mb GROUP BY 1, 2")
def _(d: Tables):
    cube = Cube(d.cells_mb.df.select((F.col("band") - 1).alias("t"), F.lit("v").alias("variable"), F.lit(1).alias("band"), "row", "col", "value"), GRID)
    return cube.reduce("mean", skipna=False).select("row", "col", r6("value").alias("value"))


def cube_rows(x):
    return x.df.select("t", "row", "col", "value")


@query("g015_create_cube", "SELECT CAST(t.range AS INT) AS t, r AS \"row\", c AS col, v AS value FROM cells, range(3) t")
def _(d: Tables):
    return cube_rows(Cube.from_raster(d.cells, 3))


@query("g014_from_files", "SELECT 0 AS t, r AS \"row\", c AS col, v AS value FROM cells UNION ALL SELECT 1, r, c, v FROM dem")
def _(d: Tables):
    return cube_rows(Cube.stack([d.cells, d.dem]))


for _name in ("g016_open_multi_dataset", "g106_data"):
    query(_name, "SELECT t, r AS \"row\", c AS col, v AS value FROM cube")(lambda d: cube_rows(d.cube))


@query("g099_head", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube WHERE t < 5")
def _(d: Tables):
    return cube_rows(d.cube.head())


@query("g100_tail", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube WHERE t > (SELECT MAX(t) FROM cube) - 5")
def _(d: Tables):
    return cube_rows(d.cube.tail())


@query("g101_first", "SELECT r AS \"row\", c AS col, v AS value FROM cube WHERE t = 0")
def _(d: Tables):
    return d.cube.first().df.select("row", "col", "value")


@query("g102_last", "SELECT r AS \"row\", c AS col, v AS value FROM cube WHERE t = (SELECT MAX(t) FROM cube)")
def _(d: Tables):
    return d.cube.last().df.select("row", "col", "value")


@query("g103_iloc", "SELECT r AS \"row\", c AS col, v AS value FROM cube WHERE t = 7")
def _(d: Tables):
    return d.cube.step(7).df.select("row", "col", "value")


@query("g104_getitem", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube WHERE t >= 3 AND t < 9")
def _(d: Tables):
    return cube_rows(d.cube.steps(3, 9))


@query("g105_setitem", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube WHERE t <> 2 UNION ALL SELECT 2, r, c, v FROM cube WHERE t = 5")
def _(d: Tables):
    return cube_rows(d.cube.replace(2, d.cube.step(5)))


@query("g107_unpack", "SELECT t, r AS \"row\", c AS col, ROUND(v * 0.01e0 + 273.15e0, 6) AS value FROM cube")
def _(d: Tables):
    x = d.cube.unpack(0.01, 273.15)
    return x.df.select("t", "row", "col", r6("value").alias("value"))


@query("g327_apply_unpack", "SELECT t, r AS \"row\", c AS col, v + 5 AS value FROM cube")
def _(d: Tables):
    return cube_rows(d.cube.unpack(None, 5))


def two(d: Tables) -> Cube:
    other = d.cube.df.withColumn("variable", F.lit("grp/twice")).withColumn("value", F.col("value") * 2)
    return d.cube.with_df(d.cube.df.unionByName(other))


@query("g108_get_variable", "SELECT t, r AS \"row\", c AS col, v * 2 AS value FROM cube")
def _(d: Tables):
    return cube_rows(two(d).variable("grp/twice"))


@query("g110_variable_names", "SELECT * FROM (VALUES ('value'), ('grp/twice')) t(variable)")
def _(d: Tables):
    return two(d).variable_names()


@query("g111_get_group", "SELECT 'twice' AS variable, COUNT(*) AS n FROM cube")
def _(d: Tables):
    return two(d).group("grp").df.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("g114_flip", "SELECT t, 9 - r AS \"row\", c AS col, v AS value FROM cube")
def _(d: Tables):
    return cube_rows(d.cube.flip())


SEL = "SELECT t, r AS \"row\", c AS col, v AS value FROM cube WHERE "


@query("g133_sel_value", SEL + "t = 4")
def _(d: Tables):
    return cube_rows(d.cube.sel(value=4))


@query("g133_sel_list", SEL + "t IN (1, 3, 8)")
def _(d: Tables):
    return cube_rows(d.cube.sel(values=[1, 3, 8]))


@query("g133_sel_slice", SEL + "t * 0.5e0 BETWEEN 2 AND 5.5")
def _(d: Tables):
    coords = d.spark.range(1000).select(F.col("id").cast("int").alias("t"), (F.col("id") * F.lit(0.5)).alias("coord"))
    return cube_rows(d.cube.sel(coords, start=2.0, stop=5.5))


@query("g136_sel_time", SEL + "t = 6")
def _(d: Tables):
    return cube_rows(d.cube.steps(6, 7))


@query("g137_sel_time_range", SEL + "t >= 2 AND t < 4")
def _(d: Tables):
    return cube_rows(d.cube.steps(2, 4))


@query("g148_collection_overlay", "SELECT t, CAST(r // 5 AS BIGINT) AS class, COUNT(v) AS n, ROUND(SUM(v), 4) AS total FROM cube GROUP BY 1, 2")
def _(d: Tables):
    grid = RasterMeta(10, 10, 0.0, 10.0)
    cls = Raster(Raster.lattice(d.spark, grid).withColumn("value", F.expr("CAST(row div 5 AS DOUBLE)")), grid)
    return d.cube.overlay(cls).groupBy("t", "class").agg(F.count("value").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("g209_collection_crop", f"SELECT CAST(t.range AS INT) AS t, r AS \"row\", c AS col, CASE WHEN {IN_TRIANGLE} THEN v END AS value FROM (SELECT *, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells), range(2) t")
def _(d: Tables):
    return cube_rows(Cube.from_raster(d.cells, 2).each(lambda x: x.crop_polygons(triangle(d), trim=False)))


@query("g134_variables_crop", f"SELECT t.range AS \"var\", r AS \"row\", c AS col, CASE WHEN {IN_TRIANGLE} THEN v * (t.range + 1) END AS value FROM (SELECT *, c + 0.5e0 AS x, 40 - (r + 0.5e0) AS y FROM cells), range(2) t")
def _(d: Tables):
    c = Cube.from_raster(d.cells, 1, "0")
    c = c.add(c.with_df(c.df.withColumn("variable", F.lit("1")).withColumn("value", F.col("value") * 2)))
    return c.each(lambda x: x.crop_polygons(triangle(d), trim=False)).df.select(F.col("variable").cast("long").alias("var"), "row", "col", "value")


@query("g210_collection_align", f"SELECT CAST(t.range AS INT) AS t, CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, v AS value FROM range(2) t CROSS JOIN range(10) a CROSS JOIN range(12) b LEFT JOIN cells ON {ALIGN_JOIN}")
def _(d: Tables):
    return cube_rows(Cube.from_raster(d.cells, 2).each(lambda x: S.align(x, TARGET)))


@query("g213_variables_resample", "SELECT CAST(t.range AS INT) AS t, CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, v AS value FROM range(2) t CROSS JOIN range(16) a CROSS JOIN range(20) b LEFT JOIN cells ON r = FLOOR((a.range + 0.5e0) * 2.5e0) AND c = FLOOR((b.range + 0.5e0) * 2.5e0)")
def _(d: Tables):
    return cube_rows(Cube.from_raster(d.cells, 2).each(lambda x: S.resample(x, 2.5)))


@query("g208_collection_to_crs")
def _(d: Tables):
    return cube_rows(Cube.from_raster(d.cells, 2).each(lambda x: S.to_crs(x, 3857)))


@query("g235_iterate", "SELECT t, COUNT(*) AS cells, ROUND(SUM(v), 4) AS total FROM cube GROUP BY 1")
def _(d: Tables):
    return d.cube.df.groupBy("t").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum("value"), 4).alias("total")).orderBy("t")


@query("g236_length", "SELECT COUNT(DISTINCT t) AS steps FROM cube")
def _(d: Tables):
    return d.cube.length()


@query("g241_add_variable", "SELECT n AS variable, COUNT(*) AS cells FROM cube, (VALUES ('value'), ('value-new')) x(n) GROUP BY 1")
def _(d: Tables):
    return d.cube.add(d.cube).df.groupBy("variable").agg(F.count(F.lit(1)).alias("cells"))


@query("g242_remove_variable", "SELECT 'value' AS variable, COUNT(*) AS cells FROM cube")
def _(d: Tables):
    return two(d).remove("grp/twice").df.groupBy("variable").agg(F.count(F.lit(1)).alias("cells"))


@query("g243_rename_variable", "SELECT n AS variable, COUNT(*) AS cells FROM cube, (VALUES ('heat'), ('grp/twice')) x(n) GROUP BY 1")
def _(d: Tables):
    return two(d).rename("value", "heat").df.groupBy("variable").agg(F.count(F.lit(1)).alias("cells"))


@query("g244_set_variable", "SELECT 'value' AS variable, COUNT(*) AS cells, ROUND(SUM(v), 4) AS total FROM cube UNION ALL SELECT 'grp/twice', COUNT(*), ROUND(SUM(v), 4) FROM cube WHERE t = 3")
def _(d: Tables):
    return two(d).set("grp/twice", d.cube.step(3)).df.groupBy("variable").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum("value"), 4).alias("total"))


@query("g330_collection_apply", "SELECT t, r AS \"row\", c AS col, ROUND(SQRT(ABS(v)), 6) AS value FROM cube")
def _(d: Tables):
    x = d.cube.apply(lambda a: np.sqrt(np.abs(a)))
    return x.df.select("t", "row", "col", r6("value").alias("value"))


@query("cube_rollup", "SELECT t, r AS \"row\", COUNT(v) AS \"count\", ROUND(AVG(v), 5) AS mean, MIN(v) AS \"min\", MAX(v) AS \"max\" FROM cube GROUP BY ROLLUP (t, r)")
def _(d: Tables):
    return d.cube.rollup("t", "row").select("t", "row", "count", rnd("mean", 5).alias("mean"), "min", "max")


@query("cube_merge", "SELECT r AS \"row\", c AS col, max_by(v, t) AS value FROM cube GROUP BY 1, 2")
def _(d: Tables):
    return d.cube.merge().select("row", "col", "value")
