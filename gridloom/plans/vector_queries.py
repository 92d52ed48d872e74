"""Queries over features, meshes, nearest neighbours and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..meta import RasterMeta
from ..operators import vector as V
from ..operators.mesh import Mesh, normalise
from ..operators.neighbours import points_in_polygons
from .base import Tables, query, rnd

FEATURES = """
WITH f AS (SELECT zid AS id, CASE zid % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'Point' ELSE 'LineString' END AS kind, x0, y0, x1, y1 FROM zones)
"""


def features(d: Tables):
    """Zones as polygons, two-part multi-polygons, points and lines in turn."""
    z = d.zones.withColumnRenamed("zone", "id")
    p = lambda x, y: G.xy(F.col(x), F.col(y))
    ring = F.array(p("x0", "y0"), p("x0", "y1"), p("x1", "y1"), p("x1", "y0"), p("x0", "y0"))
    far = F.transform(ring, lambda q: F.struct((q["x"] + 100).alias("x"), q["y"].alias("y")))
    k = F.col("id") % 4
    kind = F.when(k == 0, "Polygon").when(k == 1, "MultiPolygon").when(k == 2, "Point").otherwise("LineString")
    parts = F.when(k == 0, F.array(ring)).when(k == 1, F.array(ring, far)).when(k == 2, F.array(F.array(p("x0", "y0")))).otherwise(F.array(F.array(p("x0", "y0"), p("x1", "y1"))))
    return z.select("id", F.struct(kind.alias("type"), parts.alias("parts")).alias("geom"))


@query("g178_schema", "SELECT 'id' AS property, 'int' AS type, 'Unknown' AS geometry, 4326 AS epsg")
def _(d: Tables):
    return V.schema_of(features(d), 4326)


@query("g179_top_left_corner", "SELECT MIN(x0) AS x, MAX(y1) AS y FROM zones")
def _(d: Tables):
    b = V.total_bounds(d.zones.select("geom"))
    return b.select(F.col("xmin").alias("x"), F.col("ymax").alias("y"))


@query("g180_total_bounds", "SELECT MIN(x) AS xmin, MIN(y) AS ymin, MAX(x) AS xmax, MAX(y) AS ymax FROM pts")
def _(d: Tables):
    return V.total_bounds(d.points.select(G.point(F.col("x"), F.col("y")).alias("geom")))


@query("g240_concat", "SELECT zid AS zone, name, NULL AS label FROM zones UNION ALL SELECT NULL, NULL, label FROM pts")
def _(d: Tables):
    return V.concat(d.zones.select("zone", "name"), d.points.select("label"), 4326, 4326).select("zone", "name", "label")


@query("g250_with_coordinates", FEATURES + """
, p AS (SELECT id, [x0, x0, x1, x1, x0] AS x, [y0, y1, y1, y0, y0] AS y FROM f WHERE kind IN ('Polygon', 'MultiPolygon')
  UNION ALL SELECT id, [x0 + 100, x0 + 100, x1 + 100, x1 + 100, x0 + 100], [y0, y1, y1, y0, y0] FROM f WHERE kind = 'MultiPolygon'
  UNION ALL SELECT id, [x0], [y0] FROM f WHERE kind = 'Point' UNION ALL SELECT id, [x0, x1], [y0, y1] FROM f WHERE kind = 'LineString')
SELECT id, x, y FROM p""")
def _(d: Tables):
    return V.with_coordinates(features(d)).select("id", "x", "y")


@query("g251_with_centroid", FEATURES + """
SELECT id, ROUND(CASE kind WHEN 'Polygon' THEN (3 * x0 + 2 * x1) / 5 WHEN 'MultiPolygon' THEN (3 * x0 + 2 * x1) / 5 + 50 WHEN 'Point' THEN x0 ELSE (x0 + x1) / 2 END, 6) AS avg_x,
  ROUND(CASE kind WHEN 'Point' THEN y0 WHEN 'LineString' THEN (y0 + y1) / 2 ELSE (3 * y0 + 2 * y1) / 5 END, 6) AS avg_y FROM f""")
def _(d: Tables):
    return V.with_centroid(features(d)).select("id", rnd("avg_x", 6).alias("avg_x"), rnd("avg_y", 6).alias("avg_y"))


for _name in ("g252_create_polygon", "g253_polygon_wkt", "g268_create_polygon", "g269_polygon_wkt"):
    query(_name, "SELECT zid, format('POLYGON (({:.0f} {:.0f}, {:.0f} {:.0f}, {:.0f} {:.0f}, {:.0f} {:.0f}))', x0, y0, x1, y0, x1, y1, x0, y0) AS wkt FROM zones")(
        lambda d: d.zones.select(F.col("zone").alias("zid"), G.ring_wkt(G.close(F.array(G.xy(F.col("x0"), F.col("y0")), G.xy(F.col("x1"), F.col("y0")), G.xy(F.col("x1"), F.col("y1"))))).alias("wkt"))
    )
for _name in ("g254_create_points", "g255_point_collection", "g270_create_points", "g271_point_collection"):
    query(_name, "SELECT vec_id, x, y, label FROM pts")(lambda d: d.points.withColumn("geom", G.point(F.col("x"), F.col("y"))).select("vec_id", F.col("geom.parts")[0][0]["x"].alias("x"), F.col("geom.parts")[0][0]["y"].alias("y"), "label"))


@query("g260_explode", FEATURES + "SELECT id, kind = 'MultiPolygon' AS was_multi, CASE kind WHEN 'MultiPolygon' THEN 'Polygon' ELSE kind END AS type, i AS part FROM f, (VALUES (0), (1)) p(i) WHERE i = 0 OR kind = 'MultiPolygon'")
def _(d: Tables):
    return V.explode_multi(features(d)).select("id", "was_multi", F.col("geom.type").alias("type"), "part")


COORDS = FEATURES + "SELECT id, CASE kind WHEN 'Polygon' THEN [x0, x0, x1, x1, x0] WHEN 'Point' THEN [x0] ELSE [x0, x1] END AS x FROM f WHERE {}"
for _name, _where, _cond in (
    ("g261_get_coords", "kind <> 'MultiPolygon'", "geom.type <> 'MultiPolygon'"), ("g262_get_xy_coords", "kind <> 'MultiPolygon'", "geom.type <> 'MultiPolygon'"), ("g263_point_coords", "kind = 'Point'", "geom.type = 'Point'"),
    ("g264_line_coords", "kind = 'LineString'", "geom.type = 'LineString'"), ("g265_polygon_coords", "kind = 'Polygon'", "geom.type = 'Polygon'"),
):
    query(_name, COORDS.format(_where))(lambda d, c=_cond: features(d).filter(c).select("id", V.coords(F.col("geom"), "x").alias("x")))


@query("g266_multi_coords", FEATURES + "SELECT id, [[y0, y1, y1, y0, y0], [y0, y1, y1, y0, y0]] AS y FROM f WHERE kind = 'MultiPolygon'")
def _(d: Tables):
    return features(d).filter("geom.type = 'MultiPolygon'").select("id", V.part_coords(F.col("geom"), "y").alias("y"))


@query("g267_collection_coords", FEATURES + "SELECT id, CASE kind WHEN 'Polygon' THEN [x0, x0, x1, x1, x0] WHEN 'MultiPolygon' THEN [x0, x0, x1, x1, x0, x0 + 100, x0 + 100, x1 + 100, x1 + 100, x0 + 100] WHEN 'Point' THEN [x0] ELSE [x0, x1] END AS x FROM f")
def _(d: Tables):
    return features(d).select("id", G.xs(G.vertices(F.col("geom"))).alias("x"))


@query("g021_bbox_filter", "SELECT zid, name FROM zones WHERE x0 <= 23 AND x1 >= 8 AND y0 <= 30.5 AND y1 >= 17")
def _(d: Tables):
    return V.in_box(d.zones, 8.0, 17.0, 23.0, 30.5).select(F.col("zone").alias("zid"), "name")


@query("g022_columns_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'O'")
def _(d: Tables):
    return d.read("orders").filter((F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("g024_feature_chunks", "SELECT vec_id // 100 AS chunk, COUNT(*) AS n FROM pts WHERE x BETWEEN 24 AND 26 GROUP BY 1")
def _(d: Tables):
    return d.points.filter(F.col("x").between(24, 26)).groupBy(F.expr("vec_id div 100").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("g153_sjoin", "SELECT vec_id, zid, name FROM pts JOIN zones ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def _(d: Tables):
    return points_in_polygons(d.points.select("vec_id", "x", "y"), d.zones.select(F.col("zone").alias("zid"), "name", "geom"), 8.0).select("vec_id", "zid", "name")


@query("g153_sjoin_left", "SELECT vec_id, zid FROM pts LEFT JOIN (SELECT * FROM zones WHERE zid % 2 = 0) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def _(d: Tables):
    return points_in_polygons(d.points.select("vec_id", "x", "y"), d.zones.filter("zone % 2 = 0").select(F.col("zone").alias("zid"), "geom"), 8.0, "left").select("vec_id", "zid")


@query("g153_clip_points", "SELECT vec_id FROM pts WHERE EXISTS (SELECT 1 FROM zones WHERE zid % 3 = 0 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)")
def _(d: Tables):
    return points_in_polygons(d.points.select("vec_id", "x", "y"), d.zones.filter("zone % 3 = 0").select("geom"), 8.0, "semi").select("vec_id")


@query("g153_dissolve", "SELECT zid % 5 AS k, MIN(x0) AS xmin, MAX(y1) AS ymax, COUNT(*) AS parts FROM zones GROUP BY 1")
def _(d: Tables):
    g = d.zones.groupBy((F.col("zone") % 5).alias("k")).agg(F.struct(F.lit("MultiPolygon").alias("type"), F.flatten(F.collect_list("geom.parts")).alias("parts")).alias("geom"))
    x0, _, _, y1 = G.bounds(F.col("geom"))
    return g.select("k", x0.alias("xmin"), y1.alias("ymax"), F.size("geom.parts").cast("long").alias("parts"))


@query("g154_spatial_shuffle")
def _(d: Tables):
    return V.spatial_shuffle(d.points.withColumn("geom", G.point(F.col("x"), F.col("y"))), (0, 0, 50, 40), level=8, partitions=4).select("vec_id", "curve")


# -- meshes -----------------------------------------------------------------------------------------------------------------------


@query("g034_mesh_faces", "SELECT face_id, ns AS nodes FROM faces")
def _(d: Tables):
    return d.mesh.faces.select("face_id", "nodes")


@query("g181_mesh_bounds", "SELECT MIN(x) AS xmin, MIN(y) AS ymin, MAX(x) AS xmax, MAX(y) AS ymax FROM nodes")
def _(d: Tables):
    return d.mesh.bounds()


@query("g182_face_centroids", "SELECT face_id, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y FROM corners JOIN nodes USING (node_id) GROUP BY 1")
def _(d: Tables):
    return d.mesh.centroids().select("face_id", rnd("x", 6).alias("x"), rnd("y", 6).alias("y"))


@query("g183_face_areas", """
WITH s AS (SELECT face_id, x, y, COALESCE(LEAD(x) OVER w, FIRST_VALUE(x) OVER w) AS nx, COALESCE(LEAD(y) OVER w, FIRST_VALUE(y) OVER w) AS ny FROM corners JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY face_id ORDER BY i))
SELECT face_id, ABS(SUM(x * ny - nx * y)) / 2 AS area FROM s GROUP BY 1
""")
def _(d: Tables):
    return d.mesh.areas()


@query("g184_nodes_per_element", "SELECT face_id, CAST(len(ns) AS INT) AS n FROM faces")
def _(d: Tables):
    return d.mesh.nodes_per_face()


@query("g185_is_triangular", "SELECT bool_and(len(ns) = 3) AS triangular FROM faces")
def _(d: Tables):
    return d.mesh.is_triangular()


@query("g272_fan_triangles", "SELECT face_id, CAST(j.range - 1 AS INT) AS tri, ns[1] AS n0, ns[1 + j.range] AS n1, ns[2 + j.range] AS n2 FROM faces, range(1, 3) j WHERE 2 + j.range <= len(ns)")
def _(d: Tables):
    return d.mesh.fan()


EDGES = """
WITH s AS (SELECT face_id, i, node_id AS a, COALESCE(LEAD(node_id) OVER w, FIRST_VALUE(node_id) OVER w) AS b FROM corners WINDOW w AS (PARTITION BY face_id ORDER BY i)),
e AS (SELECT LEAST(a, b) AS n1, GREATEST(a, b) AS n2, MIN(face_id * 100 + i) AS pos, COUNT(*) AS k, MIN(face_id) AS f1, MAX(face_id) AS f2 FROM s GROUP BY 1, 2),
edges AS (SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS edge_id, * FROM e)
"""


@query("g273_edges", EDGES + "SELECT edge_id, n1, n2 FROM edges")
def _(d: Tables):
    return d.mesh.numbered_edges()


@query("g274_face_neighbours", EDGES + "SELECT f1 AS face_id, f2 AS neighbour FROM e WHERE k = 2 UNION SELECT f2, f1 FROM e WHERE k = 2")
def _(d: Tables):
    return d.mesh.neighbours()


@query("g275_face_nodes", "SELECT unnest(ns) AS node_id FROM faces WHERE face_id = 4")
def _(d: Tables):
    return d.mesh.corners().filter("face_id = 4").select("node_id")


@query("g276_face_polygon", "SELECT face_id, 'POLYGON ((' || string_agg(format('{:.0f} {:.0f}', x, y), ', ' ORDER BY i) || ', ' || arg_min(format('{:.0f} {:.0f}', x, y), i) || '))' AS wkt FROM corners JOIN nodes USING (node_id) GROUP BY 1")
def _(d: Tables):
    return d.mesh.geometries().withColumnRenamed("elem_id", "face_id")


@query("g277_edge_coords", EDGES + "SELECT edge_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM edges JOIN nodes p ON p.node_id = n1 JOIN nodes q ON q.node_id = n2")
def _(d: Tables):
    return d.mesh.edge_coords()


@query("g278_get_element", "SELECT face_id, node_id FROM corners WHERE face_id IN (0, 7)")
def _(d: Tables):
    return d.mesh.corners().filter("face_id IN (0, 7)").select("face_id", "node_id")


@query("g279_masked", "SELECT * FROM (VALUES (0, [1, 2, NULL]), (1, [3, 4, 5])) t(face_id, nodes)")
def _(d: Tables):
    padded = d.spark.createDataFrame([(0, [1, 2, -1]), (1, [3, 4, 5])], "face_id int, nodes array<int>")
    return Mesh(d.mesh.nodes, padded).masked()


@query("g280_normalise", "SELECT * FROM (VALUES (0, [0, 1, -1]), (1, [2, 3, 4])) t(face_id, nodes)")
def _(d: Tables):
    raw = d.spark.createDataFrame([(0, [1, 2, 999]), (1, [3, 4, 5])], "face_id int, nodes array<int>")
    return raw.select("face_id", normalise(F.col("nodes"), 1, 999).alias("nodes"))


def with_values(d: Tables) -> Mesh:
    n = d.mesh.nodes
    v = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.lit("level").alias("variable"), F.lit("node").alias("location"), "t", F.col("node_id").alias("elem_id"), (F.col("x") * 3 + F.col("y") * F.col("y") + F.col("t")).alias("value"))
    return Mesh(n, d.mesh.faces, v)


@query("g115_get_data", "SELECT CAST(t.range AS INT) AS t, node_id AS elem_id, x * 3 + y * y + t.range AS value FROM nodes, range(4) t")
def _(d: Tables):
    return with_values(d).data("level").select("t", "elem_id", "value")


@query("g116_time_values", "SELECT CAST(range AS INT) AS t FROM range(4)")
def _(d: Tables):
    return with_values(d).values.select("t").distinct()


@query("g136_mesh_sel_time", "SELECT node_id AS elem_id, x * 3 + y * y + 2 AS value FROM nodes")
def _(d: Tables):
    return with_values(d).time_step(2).values.select("elem_id", "value")


@query("g137_mesh_time_range", "SELECT CAST(t.range AS INT) AS t, node_id AS elem_id, x * 3 + y * y + t.range AS value FROM nodes, range(1, 3) t")
def _(d: Tables):
    return with_values(d).time_range(1, 3).values.select("t", "elem_id", "value")


for _name in ("g281_to_geodataframe", "g282_to_feature_collection"):
    query(_name, "SELECT node_id AS elem_id, format('POINT ({:.0f} {:.0f})', x, y) AS wkt, x * 3 + y * y AS value FROM nodes")(lambda d: with_values(d).geometries("node").join(with_values(d).time_step(0).values.select("elem_id", "value"), "elem_id"))


@query("g142_nodes_in_bounds", "SELECT node_id, x, y FROM nodes WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 4.5")
def _(d: Tables):
    return d.mesh.nodes_in(1, 2, 3, 4.5)


CENTROIDS = "WITH ce AS (SELECT face_id, AVG(x) AS x, AVG(y) AS y FROM corners JOIN nodes USING (node_id) GROUP BY 1)\n"


@query("g143_faces_in_bounds", CENTROIDS + "SELECT face_id FROM ce WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 4.5")
def _(d: Tables):
    return d.mesh.faces_in(1, 2, 3, 4.5).select("face_id")


SUBSET = CENTROIDS.strip() + """, s AS (SELECT face_id FROM ce WHERE x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 3),
u AS (SELECT DISTINCT node_id FROM corners JOIN s USING (face_id)), nn AS (SELECT node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS INT) AS n FROM u),
ff AS (SELECT face_id, CAST(row_number() OVER (ORDER BY face_id) - 1 AS INT) AS f FROM s)
"""


@query("g140_subset_by_bounds", SUBSET + "SELECT f AS face_id, list(nn.n ORDER BY i) AS nodes FROM corners JOIN ff USING (face_id) JOIN nn USING (node_id) GROUP BY 1")
def _(d: Tables):
    return d.mesh.subset_by_bounds(1, 1, 4, 3).faces


@query("g141_subset_nodes", SUBSET + "SELECT n AS node_id, x, y FROM nodes JOIN nn USING (node_id)")
def _(d: Tables):
    return d.mesh.subset_by_bounds(1, 1, 4, 3).nodes


@query("g139_clip_mesh")
def _(d: Tables):
    return d.mesh.clip([(0.5, 0.5), (3.5, 1.0), (2.0, 4.0)]).faces


MESH_POINTS = "WITH p AS (SELECT vec_id AS point_id, (x - 21) * 0.6e0 AS x, (y - 16.5e0) * 0.7e0 AS y FROM pts)"


def mesh_points(d: Tables):
    return d.points.select(F.col("vec_id").alias("point_id"), ((F.col("x") - 21) * F.lit(0.6)).alias("x"), ((F.col("y") - F.lit(16.5)) * F.lit(0.7)).alias("y"))


@query("g150_nearest_node", MESH_POINTS + """, r AS (SELECT point_id, node_id, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS dist, row_number() OVER (PARTITION BY point_id ORDER BY (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), node_id) AS k FROM p, nodes n)
SELECT point_id, CAST(k AS INT) AS rank, node_id AS elem_id, ROUND(dist, 6) AS distance FROM r WHERE k <= 3""")
def _(d: Tables):
    return d.mesh.nearest_node(mesh_points(d), 3).withColumn("distance", rnd("distance", 6))


@query("g151_nearest_face", MESH_POINTS + """, ce AS (SELECT face_id, AVG(x) AS x, AVG(y) AS y FROM corners JOIN nodes USING (node_id) GROUP BY 1),
r AS (SELECT point_id, face_id, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS dist, row_number() OVER (PARTITION BY point_id ORDER BY (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), face_id) AS k FROM p, ce n)
SELECT point_id, CAST(k AS INT) AS rank, face_id AS elem_id, ROUND(dist, 6) AS distance FROM r WHERE k <= 1""")
def _(d: Tables):
    return d.mesh.nearest_face(mesh_points(d)).withColumn("distance", rnd("distance", 6))


@query("g152_locate_faces", MESH_POINTS + """, q AS (SELECT point_id, CAST(FLOOR(y) * 5 + FLOOR(x) AS INT) AS q, x - FLOOR(x) AS fx, y - FLOOR(y) AS fy FROM p WHERE x > 0 AND x < 5 AND y > 0 AND y < 5),
h AS (SELECT point_id, q + (q + 2) // 3 + CASE WHEN q % 3 = 0 AND fy > fx THEN 1 ELSE 0 END AS face_id FROM q)
SELECT point_id, CAST(COALESCE(face_id, -1) AS INT) AS face_id FROM p LEFT JOIN h USING (point_id)""")
def _(d: Tables):
    return d.mesh.locate(mesh_points(d)).select("point_id", "face_id")


GRID_SQL = """
WITH t AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c, -1 + (b.range + 0.5e0) * 0.7e0 AS x, 6 - (a.range + 0.5e0) * 0.7e0 AS y FROM range(10) a, range(10) b),
n AS (SELECT r, c, v, (t.x - m.x) * (t.x - m.x) + (t.y - m.y) * (t.y - m.y) AS d2, node_id FROM t, nodes m JOIN node_values USING (node_id))
, b AS (SELECT r, c, arg_min(v, d2 * 1e6 + node_id * 1e-9) AS v, MIN(d2) AS d2 FROM n GROUP BY 1, 2)
SELECT r AS "row", c AS col, CASE WHEN d2 <= 1.4e0 * 1.4e0 THEN v END AS value FROM b
"""
for _name in ("g221_mesh_to_grid", "g222_interpolate_nearest", "g224_to_dataset"):
    query(_name, GRID_SQL)(lambda d: d.mesh.to_grid(RasterMeta(10, 10, x0=-1.0, y0=6.0, dx=0.7, dy=0.7), with_values(d).time_step(0).values))


@query("g223_interpolate_linear", "SELECT CAST(a.range AS INT) AS \"row\", CAST(b.range AS INT) AS col, ROUND(3 * (b.range + 0.5e0) * 0.625e0 + 2 * (5 - (a.range + 0.5e0) * 0.625e0), 6) AS value FROM range(8) a, range(8) b")
def _(d: Tables):
    from ..operators.triangulate import linear_grid

    v = d.mesh.nodes.select("x", "y", (F.col("x") * 3 + F.col("y") * 2).alias("value"))
    return linear_grid(v, RasterMeta(8, 8, x0=0.0, y0=5.0, dx=0.625, dy=0.625)).select("row", "col", rnd("value", 6).alias("value"))
