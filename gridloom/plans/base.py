"""Rasters, cubes, features and meshes derived from the star-schema tables, in Spark and as SQL views, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..meta import RasterMeta
from ..operators.cube import Cube
from ..operators.mesh import Mesh
from ..operators.raster import Raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GRID = RasterMeta(rows=40, cols=50, x0=0.0, y0=40.0)

VIEWS = """
lattice AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM range(40) a, range(50) b),
raw1 AS (SELECT CAST(l_orderkey % 40 AS INT) r, CAST(l_partkey % 50 AS INT) c, ROUND(AVG(l_quantity), 6) v1, ROUND(AVG(l_discount * 100), 6) v2, ROUND(AVG(l_linenumber), 6) v3 FROM lineitem GROUP BY 1, 2),
cells AS (SELECT l.r, l.c, CASE WHEN (l.r * 7 + l.c * 13) % 11 <> 0 THEN v1 END AS v FROM lattice l LEFT JOIN raw1 USING (r, c)),
cells_mb AS (SELECT b.range + 1 AS band, l.r, l.c, CASE WHEN (l.r * 7 + l.c * 13) % 11 = 0 THEN NULL WHEN b.range = 0 THEN v1 WHEN b.range = 1 THEN v2 ELSE v3 END AS v FROM lattice l CROSS JOIN range(3) b LEFT JOIN raw1 USING (r, c)),
dem AS (SELECT l.r, l.c, ROUND(100 + 5 * SIN(l.r / 5e0) + 3 * COS(l.c / 7e0) + COALESCE(v1, 25), 6) AS v FROM lattice l LEFT JOIN raw1 USING (r, c)),
classes AS (SELECT r, c, (r // 8) * 10 + c // 10 AS k FROM lattice),
cube AS (SELECT CAST(date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) AS INT) AS t, CAST(user_id % 10 AS INT) AS r, CAST(event_id % 10 AS INT) AS c, ROUND(AVG(value), 6) AS v FROM events GROUP BY 1, 2, 3),
pts AS (SELECT vec_id, ROUND(25 + 10 * CAST(embedding[1] AS DOUBLE), 6) AS x, ROUND(20 + 8 * CAST(embedding[2] AS DOUBLE), 6) AS y, label FROM embeddings),
zones AS (SELECT n_nationkey AS zid, n_name AS name, CAST((n_nationkey % 5) * 10 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 8 AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 10 + 10 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 8 + 8 AS DOUBLE) AS y1 FROM nation),
nodes AS (SELECT CAST(b.range * 6 + a.range AS INT) AS node_id, CAST(a.range AS DOUBLE) AS x, CAST(b.range AS DOUBLE) AS y FROM range(6) a, range(6) b),
quads AS (SELECT CAST(b.range * 5 + a.range AS INT) AS q, CAST(b.range * 6 + a.range AS INT) AS n FROM range(5) a, range(5) b),
faces AS (SELECT CAST(row_number() OVER (ORDER BY q, h) - 1 AS INT) AS face_id, ns FROM (
  SELECT q, 0 AS h, [n, n + 1, n + 7, n + 6] AS ns FROM quads WHERE q % 3 <> 0
  UNION ALL SELECT q, 0, [n, n + 1, n + 7] FROM quads WHERE q % 3 = 0
  UNION ALL SELECT q, 1, [n, n + 7, n + 6] FROM quads WHERE q % 3 = 0)),
corners AS (SELECT face_id, u.i - 1 AS i, ns[u.i] AS node_id, len(ns) AS n FROM faces, unnest(range(1, len(ns) + 1)) u(i)),
node_values AS (SELECT node_id, ROUND(x * 3 + y * y, 6) AS v FROM nodes)
"""


def rnd(value, digits: int):
    """Rounded, a little away from ties: sums in another order then give the same digits. nudged() does the same to SQL."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + F.lit(float(f"3.7e-{digits + 3}")), digits)


def nudged(sql: str) -> str:
    out, at = "", 0
    for m in re.finditer(r"\bROUND\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner, _, digits = sql[m.end() : i - 1].rpartition(",")
        out += f"{sql[at : m.start()]}ROUND(({nudged(inner)}) + 3.7e-{int(digits) + 3}, {int(digits)})"
        at = i
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query; sql reads the derived views."""

    def add(f: Callable[["Tables"], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = nudged(sql.strip())
            kind = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
            ORACLES[name] = f"{kind}{VIEWS.strip()}" + (f",\n{body[len(kind):]}" if body[:5].upper() == "WITH " else f"\n{body}")
        return f

    return add


class Tables:
    """The derived inputs, lazily, as in VIEWS."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _raw(self) -> DataFrame:
        li = self.read("lineitem").groupBy((F.col("l_orderkey") % 40).cast("int").alias("row"), (F.col("l_partkey") % 50).cast("int").alias("col"))
        return li.agg(F.round(F.avg("l_quantity"), 6).alias("v1"), F.round(F.avg(F.col("l_discount") * 100), 6).alias("v2"), F.round(F.avg("l_linenumber"), 6).alias("v3"))

    def _grid(self, value, bands: int = 1) -> Raster:
        df = Raster.lattice(self.spark, GRID, bands).join(self._raw, ["row", "col"], "left")
        return Raster(df.select("band", "row", "col", value.alias("value")), GRID.with_(bands=bands))

    @cached_property
    def cells(self) -> Raster:
        hole = (F.col("row") * 7 + F.col("col") * 13) % 11 == 0
        return self._grid(F.when(~hole, F.col("v1")))

    @cached_property
    def cells_mb(self) -> Raster:
        hole = (F.col("row") * 7 + F.col("col") * 13) % 11 == 0
        return self._grid(F.when(hole, None).when(F.col("band") == 1, F.col("v1")).when(F.col("band") == 2, F.col("v2")).otherwise(F.col("v3")), 3)

    @cached_property
    def dem(self) -> Raster:
        v = F.lit(100.0) + F.lit(5.0) * F.sin(F.col("row") / F.lit(5.0)) + F.lit(3.0) * F.cos(F.col("col") / F.lit(7.0)) + F.coalesce("v1", F.lit(25.0))
        return self._grid(F.round(v, 6))

    @cached_property
    def classes(self) -> Raster:
        df = Raster.lattice(self.spark, GRID).withColumn("value", F.expr("CAST((row div 8) * 10 + col div 10 AS DOUBLE)"))
        return Raster(df, GRID)

    @cached_property
    def cube(self) -> Cube:
        e = self.read("events")
        first = e.agg(F.min("ts").alias("t0"))  # one row
        df = e.join(F.broadcast(first)).select(F.date_diff(F.to_date("ts"), F.to_date("t0")).alias("t"), (F.col("user_id") % 10).cast("int").alias("row"), (F.col("event_id") % 10).cast("int").alias("col"), "value")
        df = df.groupBy("t", "row", "col").agg(F.round(F.avg("value"), 6).alias("value")).select("t", F.lit("value").alias("variable"), F.lit(1).alias("band"), "row", "col", "value")
        return Cube(df, RasterMeta(10, 10, 0.0, 10.0))

    @cached_property
    def points(self) -> DataFrame:
        e = lambda i: F.element_at("embedding", i).cast("double")
        return self.read("embeddings").select("vec_id", F.round(F.lit(25.0) + F.lit(10.0) * e(1), 6).alias("x"), F.round(F.lit(20.0) + F.lit(8.0) * e(2), 6).alias("y"), "label")

    @cached_property
    def zones(self) -> DataFrame:
        n = self.read("nation")
        k = F.col("n_nationkey")
        x0, y0 = (k % 5 * 10).cast("double"), (F.expr("n_nationkey div 5") * 8).cast("double")
        return n.select(k.alias("zone"), F.col("n_name").alias("name"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 8).alias("y1")).withColumn("geom", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))

    @cached_property
    def mesh(self) -> Mesh:
        nodes = self.spark.range(36).select(F.col("id").cast("int").alias("node_id"), (F.col("id") % 6).cast("double").alias("x"), F.expr("CAST(id div 6 AS DOUBLE)").alias("y"))
        q = self.spark.range(25).select(F.col("id").cast("int").alias("q"), F.expr("CAST((id div 5) * 6 + id % 5 AS INT)").alias("n"))
        n = F.col("n")
        whole, a, b = F.array(n, n + 1, n + 7, n + 6), F.array(n, n + 1, n + 7), F.array(n, n + 7, n + 6)
        parts = q.select("q", F.posexplode(F.when(F.col("q") % 3 != 0, F.array(whole)).otherwise(F.array(a, b))).alias("h", "nodes"))
        before = F.expr("CAST(q + (q + 2) div 3 + h AS INT)")  # every third quad before it gave two faces
        return Mesh(nodes, parts.select(before.alias("face_id"), "nodes"))
