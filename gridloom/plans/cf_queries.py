"""Queries over climate metadata, paths, catalogues and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cf, colors
from ..sources import paths, stac
from .base import Tables, query, rnd

M = "map<string,string>"


def when(d: Tables, rows: list, schema: str):
    return d.spark.createDataFrame(rows, schema)


@query("g112_time_stamp", "SELECT DISTINCT t, strftime(DATE '1979-01-01' + CAST(t AS INT), '%Y-%m-%d') AS stamp FROM cube")
def _(d: Tables):
    t = d.cube.df.select("t").distinct()
    return t.select("t", cf.decode_time(F.col("t"), F.lit("days since 1979-1-1"), "yyyy-MM-dd").alias("stamp"))


@query("g113_time_variable", "SELECT DISTINCT t, strftime(TIMESTAMP '2000-02-28 06:00:00' + to_hours(CAST(t * 6 AS INT)), '%Y/%m/%d %H') AS stamp FROM cube")
def _(d: Tables):
    t = d.cube.df.select("t").distinct()
    return t.select("t", cf.decode_time(F.col("t") * 6, F.lit("hours since 2000-2-28 6:0"), "yyyy/MM/dd HH").alias("stamp"))


@query("g286_time_conversion", """
SELECT o_orderkey AS k, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(o_orderkey % 100000 * 97 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS a, strftime(TIMESTAMP '1900-01-01 12:30:00' + to_minutes(CAST(o_orderkey % 5000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS b FROM orders
""")
def _(d: Tables):
    k = F.col("o_orderkey")
    return d.read("orders").select(k.alias("k"), cf.decode_time(k % 100000 * 97, F.lit("seconds since 1970-01-01")).alias("a"), cf.decode_time(k % 5000, F.lit("minutes since 1900-1-1 12:30:0.0")).alias("b"))


@query("g286_other_calendars", "SELECT * FROM (VALUES (0, '2001-01-01', '2001-01-01'), (59, '2001-02-30', '2001-03-01'), (360, '2002-01-01', '2001-12-27'), (365, '2002-01-06', '2002-01-01'), (1000, '2003-10-11', '2003-09-28')) t(n, d360, noleap)")
def _(d: Tables):
    n = when(d, [(0,), (59,), (360,), (365,), (1000,)], "n int")
    return n.select("n", cf.decode_360(F.col("n"), 2001).alias("d360"), cf.decode_noleap(F.col("n"), 2001).alias("noleap"))


UNITS = ["days since 1979-1-1", "Hours since 2000-01-01T06:30:00Z", "metres", "seconds since 1970-1-1 0:0:5.5"]


@query("g287_units_origin", "SELECT * FROM (VALUES ('days since 1979-1-1', 'days', '1979-1-1'), ('Hours since 2000-01-01T06:30:00Z', 'hours', '2000-01-01T06:30:00Z'), ('metres', NULL, NULL), ('seconds since 1970-1-1 0:0:5.5', 'seconds', '1970-1-1 0:0:5.5')) t(units, unit, origin)")
def _(d: Tables):
    u, o = cf.split_units(F.col("units"))
    return when(d, [(x,) for x in UNITS], "units string").select("units", u.alias("unit"), o.alias("origin"))


@query("g288_normalize_origin", "SELECT * FROM (VALUES ('1979-1-1', '1979-01-01 00:00:00'), ('2000-01-01T06:30:00Z', '2000-01-01 06:30:00'), ('1970-1-1 0:0:5.5', '1970-01-01 00:00:05'), ('85-12-3 7', '0085-12-03 07:00:00')) t(origin, full_origin)")
def _(d: Tables):
    return when(d, [("1979-1-1",), ("2000-01-01T06:30:00Z",), ("1970-1-1 0:0:5.5",), ("85-12-3 7",)], "origin string").select("origin", cf.origin_text(F.col("origin")).alias("full_origin"))


@query("g290_detect_axis", "SELECT * FROM (VALUES ('a', 'X'), ('b', 'Y'), ('c', 'Y'), ('d', 'X'), ('e', 'T'), ('lat', 'Y'), ('Level', 'Z'), ('q', NULL)) t(name, axis)")
def _(d: Tables):
    rows = [("a", {"axis": "x"}), ("b", {"standard_name": "Latitude"}), ("c", {"units": "degrees_north"}), ("d", {"units": " degree_E "}), ("e", {"units": "days since 1990-01-01"}), ("lat", {}), ("Level", {"axis": "q"}), ("q", {"units": "m"})]
    return when(d, rows, f"name string, attrs {M}").select("name", cf.detect_axis(F.col("name"), F.col("attrs")).alias("axis"))


VARIABLES = [
    ("/temp", {"coordinates": "lat2d lon2d", "cell_measures": "area: cell_area", "ancillary_variables": "flag", "units": "K"}), ("/time", {"bounds": "time_bnds", "units": "days since 2000-01-01"}), ("/time_bnds", {}),
    ("/lat2d", {}), ("/lon2d", {}), ("/cell_area", {}), ("/flag", {}), ("/crs", {"grid_mapping_name": "latitude_longitude"}), ("/mesh", {"cf_role": "mesh_topology"}), ("/links", {"cf_role": "face_node_connectivity"}), ("/x", {}),
]


@query("g291_classify", "SELECT * FROM (VALUES ('/temp', 'data'), ('/time', 'coordinate'), ('/time_bnds', 'bounds'), ('/lat2d', 'auxiliary_coordinate'), ('/lon2d', 'auxiliary_coordinate'), ('/cell_area', 'cell_measure'), ('/flag', 'ancillary'), ('/crs', 'grid_mapping'), ('/mesh', 'mesh_topology'), ('/links', 'connectivity'), ('/x', 'coordinate')) t(name, role)")
def _(d: Tables):
    return cf.classify(when(d, VARIABLES, f"name string, attrs {M}"), when(d, [("time",), ("x",)], "name string"))


@query("g292_conventions", "SELECT * FROM (VALUES ('CF', '1.8'), ('ACDD', '1.3'), ('UGRID', '')) t(name, version)")
def _(d: Tables):
    return when(d, [("CF-1.8 ACDD-1.3, UGRID",)], "c string").select(F.explode(cf.conventions(F.col("c"))).alias("name", "version"))


@query("g293_cell_methods", "SELECT * FROM (VALUES ('time', 'mean', NULL, NULL), ('lat lon', 'sum', 'land', NULL), ('time', 'max', NULL, 'years')) t(dims, method, \"where\", \"over\")")
def _(d: Tables):
    return when(d, [("time: mean lat: lon: sum where land time: max over years",)], "c string").select(F.explode(cf.cell_methods(F.col("c"))).alias("m")).select("m.*")


@query("g294_validate", "SELECT * FROM (VALUES ('coordinate x has no units'), ('time coordinate time has no calendar'), ('Conventions doesn''t name CF')) t(issue)")
def _(d: Tables):
    return cf.issues({}, when(d, VARIABLES, f"name string, attrs {M}"), when(d, [("time",), ("x",)], "name string"))


@query("g300_dimension_entries", "SELECT * FROM (VALUES ('time', 2, 6, [0.0::DOUBLE, 31]), ('level', 3, 4, [1000, 850, 500])) t(dim, \"size\", kind, \"values\")")
def _(d: Tables):
    rows = [("NETCDF_DIM_time_DEF", "{2,6}"), ("NETCDF_DIM_time_VALUES", "{0,31}"), ("NETCDF_DIM_level_DEF", "{3,4}"), ("NETCDF_DIM_level_VALUES", "{1000, 850, 500}"), ("NETCDF_DIM_EXTRA", "{time}")]
    return cf.dimension_entries(when(d, rows, "key string, value string"))


@query("g301_attribute_entries", "SELECT * FROM (VALUES ('lat', 'units', 'degrees_north'), ('time', 'axis', 'T'), ('time', 'units', 'days')) t(name, attr, value)")
def _(d: Tables):
    rows = [("time#Units", "days"), ("time#axis", "T"), ("lat#UNITS", "degrees_north"), ("title", "x")]
    return cf.attribute_entries(when(d, rows, "key string, value string")).select("name", F.explode("attrs").alias("attr", "value"))


@query("g305_groups", "SELECT * FROM (VALUES ('/a', 1), ('/a/b', 2), ('/c', 1), ('/a/b/d', 3)) t(path, depth)")
def _(d: Tables):
    return cf.groups(when(d, [("/a",), ("/a/b",), ("/c",), ("/a/b/d",)], "path string"))


@query("g131_valid_range", "SELECT r AS \"row\", c AS col, CASE WHEN v BETWEEN 22 AND 28 THEN v END AS value FROM cells")
def _(d: Tables):
    return d.cells.df.select("row", "col", cf.valid_range(F.col("value"), both=(22, 28)).alias("value"))


@query("g132_decode_flags", """
SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber IN (1, 2) THEN [['land', 'sea'][l_linenumber]] ELSE ['unknown'] END AS a,
  CASE WHEN l_linenumber & 3 = 0 THEN ['unknown'] ELSE list_filter([CASE WHEN l_linenumber & 1 > 0 THEN 'land' END, CASE WHEN l_linenumber & 2 > 0 THEN 'sea' END], lambda x: x IS NOT NULL) END AS b,
  CASE WHEN l_linenumber & 3 = 1 THEN ['land'] WHEN l_linenumber & 6 = 2 THEN ['sea'] ELSE ['unknown'] END AS c
FROM lineitem WHERE NOT (l_linenumber & 3 = 1 AND l_linenumber & 6 = 2)
""")
def _(d: Tables):
    arr = lambda *v: F.array(*map(F.lit, v))
    none = F.lit(None).cast("array<int>")
    n = F.col("l_linenumber")
    words = arr("land", "sea")
    return d.read("lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), cf.flags(n, arr(1, 2), words, none).alias("a"), cf.flags(n, none, words, arr(1, 2)).alias("b"), cf.flags(n, arr(1, 2), words, arr(3, 6)).alias("c"))


@query("g318_color_code", "SELECT * FROM (VALUES ('red', 3), ('alpha', 6), ('mauve', NULL)) t(name, code)")
def _(d: Tables):
    return when(d, [("red",), ("alpha",), ("mauve",)], "name string").select("name", colors.code_of(F.col("name")).alias("code"))


@query("g319_color_name", "SELECT * FROM (VALUES (3, 'red'), (12, 'yellow'), (99, NULL)) t(code, name)")
def _(d: Tables):
    return when(d, [(3,), (12,), (99,)], "code int").select("code", colors.name_of(F.col("code")).alias("name"))


# -- paths and catalogues -----------------------------------------------------------------------------------------------------------

PATHS = ["s3://b/k.tif", "gs://b/k.nc", "az://c/k", "abfs://c/k", "https://h/a.zip", "http://h/a.tif", "file:///d/x.tif", "/d/x.tif.gz", "s3://b/a.zip", "rel/x.asc"]


@query("g035_scheme", "SELECT * FROM (VALUES ('s3://b/k.tif', 's3a://b/k.tif', NULL), ('gs://b/k.nc', 'gs://b/k.nc', NULL), ('az://c/k', 'abfss://c/k', NULL), ('abfs://c/k', 'abfss://c/k', NULL), ('https://h/a.zip', 'https://h/a.zip', 'zip'), ('http://h/a.tif', 'http://h/a.tif', NULL), ('file:///d/x.tif', 'file:///d/x.tif', NULL), ('/d/x.tif.gz', '/d/x.tif.gz', 'gz'), ('s3://b/a.zip', 's3a://b/a.zip', 'zip'), ('rel/x.asc', 'rel/x.asc', NULL)) t(path, target, archive)")
def _(d: Tables):
    p = F.col("path")
    return when(d, [(x,) for x in PATHS], "path string").select("path", paths.target(p).alias("target"), paths.archive(p).alias("archive"))


@query("g036_is_remote", "SELECT p AS path, NOT (p LIKE 'file:%' OR p LIKE '/d%' OR p LIKE 'rel%') AS remote FROM (VALUES ('s3://b/k.tif'), ('gs://b/k.nc'), ('az://c/k'), ('abfs://c/k'), ('https://h/a.zip'), ('http://h/a.tif'), ('file:///d/x.tif'), ('/d/x.tif.gz'), ('s3://b/a.zip'), ('rel/x.asc')) t(p)")
def _(d: Tables):
    return when(d, [(x,) for x in PATHS], "path string").select("path", paths.is_remote(F.col("path")).alias("remote"))


FILES = ["rain_1979.01.03.tif", "rain_1979.01.01.tif", "rain_1979.01.02.tif", "rain_1979.02.01.tif", "notes.txt"]


@query("g013_read_multiple", "SELECT * FROM (VALUES (0, 'rain_1979.01.01.tif', DATE '1979-01-01'), (1, 'rain_1979.01.02.tif', DATE '1979-01-02'), (2, 'rain_1979.01.03.tif', DATE '1979-01-03')) x(t, path, stamp)")
def _(d: Tables):
    return paths.ordered_by_date(when(d, [(x,) for x in FILES], "path string"), r"\d{4}.\d{2}.\d{2}", "yyyy.MM.dd", "1979-01-01", "1979-01-31", ".tif")


@query("g237_resolve_paths", "SELECT path, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS t FROM (VALUES ('rain_1979.01.03.tif'), ('rain_1979.01.01.tif'), ('rain_1979.01.02.tif'), ('rain_1979.02.01.tif'), ('notes.txt')) x(path)")
def _(d: Tables):
    return paths.ordered(when(d, [(x,) for x in FILES], "path string"))


@query("g238_dimension_names", "SELECT * FROM (VALUES (0, 'time'), (1, 'lat'), (2, 'lon')) t(ord, name)")
def _(d: Tables):
    return when(d, [(1, "lat"), (0, "time"), (2, "lon")], "ord int, name string").orderBy("ord")


@query("g239_flatten_index", "SELECT ['a', 'b', 'z'] AS variables, ['lat', 'time'] AS dimensions, 20 AS attrs")
def _(d: Tables):
    v, n = when(d, [("z",), ("a",), ("b",)], "name string"), when(d, [("time",), ("lat",)], "name string")
    attrs = F.size(F.slice(F.map_entries(F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i.cast("string")), F.sequence(F.lit(1), F.lit(30)))), 1, 20))
    return v.agg(F.array_sort(F.collect_list("name")).alias("variables")).join(F.broadcast(n.agg(F.array_sort(F.collect_list("name")).alias("dimensions")))).withColumn("attrs", attrs)


def items(d: Tables):
    z = d.zones
    box = F.when(F.col("zone") % 7 != 3, F.array("x0", "y0", "x1", "y1"))
    return z.select(F.col("zone").alias("id"), box.alias("bbox"), F.create_map(F.lit("B04"), F.struct(F.concat(F.lit("s3://b/"), F.lower("name"), F.lit(".tif")).alias("href"))).alias("assets"))


@query("g018_from_stac", "SELECT zid AS id, 's3a://b/' || lower(name) || '.tif' AS href FROM zones WHERE (zid % 7 = 3 OR (x0 <= 25 AND x1 >= 12 AND y0 <= 20 AND y1 >= 3)) ORDER BY zid LIMIT 6")
def _(d: Tables):
    return stac.select_items(items(d), "B04", (12.0, 3.0, 25.0, 20.0), 6, paths.target)


@query("g019_item_intersects", "SELECT zid AS id, zid % 7 = 3 OR (x0 <= 25 AND x1 >= 12 AND y0 <= 20 AND y1 >= 3) AS hit FROM zones")
def _(d: Tables):
    return items(d).select("id", stac.intersects(F.col("bbox"), (12.0, 3.0, 25.0, 20.0)).alias("hit"))


@query("g020_asset_href", "SELECT zid AS id, 's3://b/' || lower(name) || '.tif' AS href FROM zones")
def _(d: Tables):
    return items(d).select("id", stac.href(F.col("assets"), "B04").alias("href"))


@query("g325_normalize_chunks", "SELECT * FROM (VALUES ('auto', 256, 256), ('128', 128, 128), ('64,32', 64, 32), ('-1,16', 40, 16)) t(chunks, rows, cols)")
def _(d: Tables):
    return when(d, [("auto",), ("128",), ("64,32",), ("-1,16",)], "chunks string").select("chunks", *paths.chunks(F.col("chunks"), 40, 50, 256))


@query("g326_default_chunks", "SELECT 256 AS rows, 256 AS cols")
def _(d: Tables):
    return d.spark.range(1).select(*paths.chunks(F.lit("auto"), 40, 50, 256))


# -- file round trips -----------------------------------------------------------------------------------------------------------------


def scratch(d: Tables, name: str) -> str:
    import uuid

    from ..sources.shared import shared_folder

    return f"{shared_folder(d.spark)}/gridloom-io/{name}-{uuid.uuid4().hex}"


@query("g007_asciigrid_round_trip", "SELECT r AS \"row\", c AS col, v AS value FROM cells")
def _(d: Tables):
    from ..sources import asciigrid

    to = scratch(d, "ascii")
    asciigrid.write(d.cells, to)
    return asciigrid.read(d.spark, to).df.select("row", "col", "value")


@query("g040_raster_parquet_round_trip", "SELECT CAST(band AS INT) AS band, r AS \"row\", c AS col, v AS value FROM cells_mb")
def _(d: Tables):
    from ..sources import tables

    to = scratch(d, "raster")
    tables.write_raster(d.cells_mb, to)
    return tables.read_raster(d.spark, to).df


@query("g045_cube_round_trip", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube")
def _(d: Tables):
    from ..sources import tables

    to = scratch(d, "cube")
    tables.write_cube(d.cube, to)
    return tables.read_cube(d.spark, to).df.select("t", "row", "col", "value")


@query("g058_geojson_round_trip", "SELECT zid, name, x0, y1 FROM zones")
def _(d: Tables):
    from ..functions import geometry as G
    from ..sources import geojson

    to = scratch(d, "geojson")
    geojson.write(d.zones.select(F.col("zone").alias("zid"), "name", "geom"), to)
    back = geojson.read(d.spark, to, "zid int, name string")
    x0, _, _, y1 = G.bounds(F.col("geom"))
    return back.select("zid", "name", x0.alias("x0"), y1.alias("y1"))


@query("g059_features_parquet_round_trip", "SELECT zid, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM zones WHERE x0 <= 30 AND x1 >= 25")
def _(d: Tables):
    from ..operators import vector
    from ..sources import tables

    to = scratch(d, "features")
    tables.write_features(d.zones.select(F.col("zone").alias("zid"), "geom"), to)
    return vector.in_box(tables.read_features(d.spark, to), 25, -100, 30, 100).drop("geom")


@query("g001_geotiff_round_trip", "SELECT CAST(band AS INT) AS band, r AS \"row\", c AS col, v AS value FROM cells_mb")
def _(d: Tables):
    from ..sources import geotiff

    to = scratch(d, "tiff")
    geotiff.write(d.cells_mb, to)
    return geotiff.read(d.spark, to).df.select("band", "row", "col", "value")


@query("g064_mesh_round_trip", "SELECT face_id, ns AS nodes FROM faces")
def _(d: Tables):
    from ..sources import tables

    to = scratch(d, "mesh")
    tables.write_mesh(d.mesh, to)
    return tables.read_mesh(d.spark, to).faces


@query("stream_windows", "SELECT CAST(epoch(ts) AS BIGINT) // 86400 AS \"day\", event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def _(d: Tables):
    from ..streaming.ingest import daily_totals

    return daily_totals(d.spark, d.dir).withColumn("total", rnd("total", 4))


@query("g030_netcdf_round_trip", "SELECT t.t, r AS \"row\", c AS col, v AS value FROM (SELECT CAST(range AS INT) AS t FROM range((SELECT max(t) + 1 FROM cube))) t CROSS JOIN (SELECT DISTINCT r, c FROM cube) LEFT JOIN cube USING (t, r, c)")
def _(d: Tables):
    from ..sources import netcdf3

    to = scratch(d, "netcdf")
    netcdf3.write(d.cube, to, d.cube._last() + 1)
    return netcdf3.read(d.spark, to, "value").df.select("t", "row", "col", "value")


@query("g003_archive_members", "SELECT * FROM (VALUES (0, 'a.txt', 'first'), (1, 'd/b.txt', 'second')) t(i, name, text)")
def _(d: Tables):
    import io
    import zipfile

    from ..sources import archives

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "first")
        z.writestr("d/b.txt", "second")
    rows = [(i, n, c.decode()) for i, (n, c) in enumerate(archives.members(raw.getvalue()))]
    return when(d, rows, "i int, name string, text string")


META_ROWS = "SELECT * FROM (VALUES ('lat', 'double', ['lat'], 'degrees_north'), ('rain', 'float', ['time', 'lat'], 'mm')) t(name, dtype, dims, unit)"


def model():
    from ..functions.metadata import Dimension, Metadata, VariableInfo

    return Metadata("netcdf3", {"title": "x"}, [Dimension("time", 2), Dimension("lat", 3)], [VariableInfo("lat", "double", ["lat"], unit="degrees_north"), VariableInfo("rain", "float", ["time", "lat"], unit="mm")])


@query("g308_metadata_json", META_ROWS)
def _(d: Tables):
    from ..functions.metadata import Metadata

    return Metadata.from_json(model().to_json()).table(d.spark).select("name", "dtype", "dims", "unit")


@query("g306_to_dict", "SELECT 'netcdf3' AS driver, 2 AS dims, 2 AS variables")
def _(d: Tables):
    x = model().to_dict()
    return when(d, [(x["driver"], len(x["dimensions"]), len(x["variables"]))], "driver string, dims int, variables int")


@query("g311_set_attribute", "SELECT * FROM (VALUES ('title', 'new'), ('source', 'y')) t(name, value)")
def _(d: Tables):
    from ..functions.metadata import set_attribute

    return when(d, [({"title": "x", "source": "y"},)], f"attrs {M}").select(F.explode(set_attribute(F.col("attrs"), "title", "new")).alias("name", "value"))


@query("g312_delete_attribute", "SELECT 'source' AS name, 'y' AS value")
def _(d: Tables):
    from ..functions.metadata import delete_attribute

    return when(d, [({"title": "x", "source": "y"},)], f"attrs {M}").select(F.explode(delete_attribute(delete_attribute(F.col("attrs"), "title"), "none")).alias("name", "value"))


@query("g122_fitting_nodata", "SELECT * FROM (VALUES ('uint8', 255.0::DOUBLE, 255.0::DOUBLE), ('int16', -9999, -9999), ('float64', -9999, 1e9), ('int8', 127, 127)) t(dtype, unset, far)")
def _(d: Tables):
    from ..functions.metadata import fitting_nodata

    return when(d, [(t, float(fitting_nodata(None if t != "int8" else 1e9, t)), float(fitting_nodata(1e9 if t != "int16" else -9999, t))) for t in ("uint8", "int16", "float64", "int8")], "dtype string, unset double, far double")


@query("g026_from_features", "SELECT zid, name FROM zones")
def _(d: Tables):
    return d.zones.select(F.col("zone").alias("zid"), "name")


@query("g027_from_records", "SELECT 1 AS id, 2.5e0 AS x, 3.5e0 AS y")
def _(d: Tables):
    from ..functions.geometry import GEOM
    from ..operators.vector import from_records

    f = from_records(d.spark, [{"id": 1, "geom": {"type": "Point", "parts": [[{"x": 2.5, "y": 3.5}]]}}], f"id int, geom {GEOM}")
    p = F.col("geom.parts")[0][0]
    return f.select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("g031_open_mfdataset", "SELECT t, r AS \"row\", c AS col, v AS value FROM cube UNION ALL SELECT CAST(t + (SELECT max(t) + 1 FROM cube) AS INT), r, c, v * 2 FROM cube")
def _(d: Tables):
    import os

    from ..operators.cube import Cube
    from ..sources import tables

    to = scratch(d, "parts")
    tables.write_cube(d.cube, f"{to}/a")
    double = d.cube.df.withColumn("value", F.col("value") * 2)
    tables.write_cube(Cube(double, d.cube.meta), f"{to}/b")
    return tables.read_cubes(d.spark, [os.path.join(to, "a"), os.path.join(to, "b")], steps=d.cube._last() + 1).df.select("t", "row", "col", "value")
