"""Unstructured meshes: nodes (node_id, x, y), faces (face_id, nodes ARRAY<INT>, -1 pads), values (variable, location, t, elem_id, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..meta import RasterMeta
from ..sources.shared import ranked
from .neighbours import nearest


def valid(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n != -1)


def normalise(nodes: Column, start_index: int = 0, fill: int = -1) -> Column:
    """Zero-based connectivity with -1 as fill."""
    return F.transform(nodes, lambda n: F.when(n == fill, F.lit(-1)).otherwise(n - start_index))


@dataclass(frozen=True)
class Mesh:
    nodes: DataFrame
    faces: DataFrame
    values: DataFrame | None = None

    def corners(self) -> DataFrame:
        """face_id, i, node_id, n: the valid corners in order."""
        f = self.faces.select("face_id", valid(F.col("nodes")).alias("v"))
        return f.select("face_id", F.size("v").alias("n"), F.posexplode("v").alias("i", "node_id"))

    def rings(self) -> DataFrame:
        """face_id and its closed ring, in corner order."""
        c = self.corners().join(self.nodes, "node_id")
        ring = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        return c.groupBy("face_id").agg(ring.alias("r")).select("face_id", F.concat("r", F.slice("r", 1, 1)).alias("ring"))

    def nodes_per_face(self) -> DataFrame:
        return self.faces.select("face_id", F.size(valid(F.col("nodes"))).alias("n"))

    def is_triangular(self) -> DataFrame:
        return self.nodes_per_face().agg(F.bool_and(F.col("n") == 3).alias("triangular"))

    def masked(self) -> DataFrame:
        return self.faces.select("face_id", F.transform("nodes", lambda n: F.nullif(n, F.lit(-1))).alias("nodes"))

    def bounds(self) -> DataFrame:
        return self.nodes.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))

    def centroids(self) -> DataFrame:
        """face_id, x, y: the mean of the corners."""
        return self.corners().join(self.nodes, "node_id").groupBy("face_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))

    def areas(self) -> DataFrame:
        return self.rings().select("face_id", (F.abs(G.shoelace(F.col("ring"))) / 2).alias("area"))

    def fan(self) -> DataFrame:
        """Triangles (n0, nj, nj+1) of each face of three corners or more."""
        v = self.faces.select("face_id", valid(F.col("nodes")).alias("v")).filter(F.size("v") >= 3)
        v = v.select("face_id", "v", F.posexplode(F.sequence(F.lit(2), F.size("v") - 1)).alias("tri", "j"))
        return v.select("face_id", "tri", F.element_at("v", 1).alias("n0"), F.element_at("v", F.col("j")).alias("n1"), F.element_at("v", F.col("j") + 1).alias("n2"))

    def face_edges(self) -> DataFrame:
        """face_id, i, n1 < n2 of every side."""
        v = self.faces.select("face_id", valid(F.col("nodes")).alias("v"))
        v = v.select("face_id", "v", F.posexplode("v").alias("i", "a")).withColumn("b", F.element_at("v", (F.col("i") + 1) % F.size("v") + 1))
        return v.select("face_id", "i", F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2"))

    def edges(self) -> DataFrame:
        """Distinct sides by first appearance: n1, n2, and first_face, first_i, which order them (edge numbers are their ranks)."""
        e = self.face_edges().groupBy("n1", "n2").agg(F.min(F.struct("face_id", "i")).alias("at"))
        return e.select("n1", "n2", F.col("at.face_id").alias("first_face"), F.col("at.i").alias("first_i"))

    def numbered_edges(self) -> DataFrame:
        """edge_id in order of first appearance."""
        e = self.edges().select("n1", "n2", F.struct("first_face", "first_i").alias("at"))
        return ranked(e, "at", "edge_id").select("edge_id", "n1", "n2")

    def edge_coords(self) -> DataFrame:
        a, b = (self.nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i, n in ((1, "n1"), (2, "n2")))
        return self.numbered_edges().join(a, "n1").join(b, "n2").select("edge_id", "x1", "y1", "x2", "y2")

    def neighbours(self) -> DataFrame:
        """face_id, neighbour over sides that exactly two faces share."""
        pair = self.face_edges().groupBy("n1", "n2").agg(F.sort_array(F.collect_set("face_id")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k = 2 AND size(f) = 2")
        both = F.array(F.struct(F.element_at("f", 1).alias("face_id"), F.element_at("f", 2).alias("neighbour")), F.struct(F.element_at("f", 2).alias("face_id"), F.element_at("f", 1).alias("neighbour")))
        return pair.select(F.explode(both).alias("p")).select("p.*").distinct()

    def geometries(self, location: str = "face") -> DataFrame:
        """elem_id and WKT of faces, nodes or edges."""
        if location == "face":
            return self.rings().select(F.col("face_id").alias("elem_id"), G.ring_wkt(F.col("ring")).alias("wkt"))
        if location == "node":
            return self.nodes.select(F.col("node_id").alias("elem_id"), G.point_wkt(F.col("x"), F.col("y")).alias("wkt"))
        text = F.concat(F.lit("LINESTRING ("), G.number(F.col("x1")), F.lit(" "), G.number(F.col("y1")), F.lit(", "), G.number(F.col("x2")), F.lit(" "), G.number(F.col("y2")), F.lit(")"))
        return self.edge_coords().select(F.col("edge_id").alias("elem_id"), text.alias("wkt"))

    # -- search -----------------------------------------------------------------------------------------------------------------

    def nodes_in(self, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
        return self.nodes.filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))

    def faces_in(self, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
        return self.centroids().filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))

    def nearest_node(self, points: DataFrame, k: int = 1, cell: float = 1.0) -> DataFrame:
        return nearest(points, self.nodes.select(F.col("node_id").alias("elem_id"), "x", "y"), k, cell)

    def nearest_face(self, points: DataFrame, k: int = 1, cell: float = 1.0) -> DataFrame:
        return nearest(points, self.centroids().select(F.col("face_id").alias("elem_id"), "x", "y"), k, cell)

    def locate(self, points: DataFrame, cell: float = 1.0) -> DataFrame:
        """points (point_id, x, y) with the least face that has them strictly inside, else -1: bucket equi-join, then ray casting."""
        rings = self.rings()
        v = F.col("ring")
        lo = lambda a: F.floor(F.array_min(a) / cell).cast("long")
        hi = lambda a: F.floor(F.array_max(a) / cell).cast("long")
        faces = rings.withColumn("bx", F.explode(F.sequence(lo(G.xs(v)), hi(G.xs(v))))).withColumn("by", F.explode(F.sequence(lo(G.ys(v)), hi(G.ys(v)))))
        p = points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("bx"), F.floor(F.col("y") / cell).alias("by"))
        on = F.exists(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: _on_segment(F.element_at("ring", i), F.element_at("ring", i + 1), F.col("x"), F.col("y")))
        hit = p.join(faces, ["bx", "by"]).filter(G.in_ring(v, F.col("x"), F.col("y")) & ~on).groupBy("point_id").agg(F.min("face_id").alias("face_id"))
        return points.join(hit, "point_id", "left").withColumn("face_id", F.coalesce("face_id", F.lit(-1)))

    # -- subsets ----------------------------------------------------------------------------------------------------------------

    def subset(self, selected: DataFrame) -> "Mesh":
        """Only the selected faces (face_id) and their nodes, both numbered anew in order."""
        faces = self.faces.join(selected.select("face_id").distinct(), "face_id", "left_semi")
        used = faces.select(F.explode(valid(F.col("nodes"))).alias("node_id")).distinct()
        nodes = ranked(self.nodes.join(used, "node_id"), "node_id", "new")
        c = Mesh(self.nodes, faces).corners().join(nodes.select("node_id", "new"), "node_id")
        rows = c.groupBy("face_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda p: p["new"]).alias("nodes"))
        rows = ranked(rows, "face_id", "new").select(F.col("new").alias("face_id"), "nodes")
        return Mesh(nodes.select(F.col("new").alias("node_id"), "x", "y"), rows)

    def subset_by_bounds(self, xmin: float, ymin: float, xmax: float, ymax: float) -> "Mesh":
        return self.subset(self.faces_in(xmin, ymin, xmax, ymax))

    def clip(self, polygon: list[tuple[float, float]], touch: bool = True) -> "Mesh":
        """Faces with a corner or centroid in the polygon, or with a polygon vertex inside (touch), or with all corners inside."""
        ring = F.array(*(G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in polygon))
        r = self.rings().withColumn("mask", G.close(ring))
        inside = lambda p: G.in_ring(F.col("mask"), p["x"], p["y"])
        hit = F.exists("ring", inside) | F.exists("mask", lambda p: G.in_ring(F.col("ring"), p["x"], p["y"])) if touch else F.forall("ring", inside)
        return self.subset(r.filter(hit))

    # -- values -----------------------------------------------------------------------------------------------------------------

    def data(self, variable: str) -> DataFrame:
        return self.values.filter(F.col("variable") == variable)

    def time_step(self, i: int) -> "Mesh":
        return Mesh(self.nodes, self.faces, self.values.filter(F.col("t") == i))

    def time_range(self, start: int, stop: int) -> "Mesh":
        return Mesh(self.nodes, self.faces, self.values.filter((F.col("t") >= start) & (F.col("t") < stop)))

    def to_grid(self, meta: RasterMeta, values: DataFrame, location: str = "node", max_distance: float | None = None) -> DataFrame:
        """row, col, value of the nearest element (elem_id, value) within max_distance (default: two cells) of each cell centre."""
        from .raster import Raster

        limit = 2 * meta.dx if max_distance is None else max_distance
        spark = self.nodes.sparkSession
        cells = Raster.lattice(spark, meta).select((F.col("row").cast("long") * meta.cols + F.col("col")).alias("point_id"), meta.x_of(F.col("col")).alias("x"), meta.y_of(F.col("row")).alias("y"), "row", "col")
        source = self.nodes.select(F.col("node_id").alias("elem_id"), "x", "y") if location == "node" else self.centroids().select(F.col("face_id").alias("elem_id"), "x", "y")
        near = nearest(cells.select("point_id", "x", "y"), source, 1, limit, within=limit)
        return cells.join(near.join(values.select("elem_id", "value"), "elem_id").select("point_id", "value"), "point_id", "left").select("row", "col", "value")


def _on_segment(a: Column, b: Column, x: Column, y: Column) -> Column:
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (F.abs(cross) < 1e-12) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
