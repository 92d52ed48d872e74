"""Features: tables with a geometry struct (see functions.geometry) and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G

MULTI = {"MultiPolygon": "Polygon", "MultiPoint": "Point", "MultiLineString": "LineString"}


def explode_multi(features: DataFrame, kind: str = "MultiPolygon", geom: str = "geom") -> DataFrame:
    """One row per part of geometries of one multi-type, other rows untouched; was_multi and part give the order (exploded rows last)."""
    g = F.col(geom)
    hit = F.lower(g["type"]) == kind.lower()
    parts = F.when(hit, F.transform(g["parts"], lambda p: F.struct(F.lit(MULTI[kind]).alias("type"), F.array(p).alias("parts")))).otherwise(F.array(g))
    rest = [c for c in features.columns if c != geom]
    return features.select(*rest, hit.alias("was_multi"), F.posexplode(parts).alias("part", geom))


def with_coordinates(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Multi-geometries exploded, with x and y lists of the vertices."""
    out = features
    for kind in MULTI:
        out = explode_multi(out, kind, geom).drop("was_multi", "part")
    v = G.vertices(F.col(geom))
    return out.withColumn("x", G.xs(v)).withColumn("y", G.ys(v))


def with_centroid(features: DataFrame, geom: str = "geom") -> DataFrame:
    """avg_x, avg_y: mean of the vertices, the closing one counted; null for empty geometries."""
    x, y = G.vertex_mean(G.vertices(F.col(geom)))
    return features.withColumn("avg_x", x).withColumn("avg_y", y)


def coords(geom: Column, axis: str) -> Column:
    """x or y of the vertices as a list; multi-polygons and empty geometries are errors."""
    v = G.vertices(geom)
    values = G.xs(v) if axis == "x" else G.ys(v)
    bad = (geom["type"] == "MultiPolygon") | (F.size(v) == 0)
    return F.when(bad, F.raise_error(F.lit("no coordinates of this geometry")).cast("array<double>")).otherwise(values)


def part_coords(geom: Column, axis: str) -> Column:
    """x or y lists of each part."""
    return F.transform(geom["parts"], lambda p: F.transform(p, lambda q: q[axis]))


def concat(a: DataFrame, b: DataFrame, epsg_a: int, epsg_b: int) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    if epsg_a != epsg_b:
        raise ValueError("the reference systems differ")
    return a.withColumn("source_table", F.lit(0)).unionByName(b.withColumn("source_table", F.lit(1)), allowMissingColumns=True)


def total_bounds(features: DataFrame, geom: str = "geom") -> DataFrame:
    x0, y0, x1, y1 = G.bounds(F.col(geom))
    return features.agg(F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))


def geometry_type(features: DataFrame, geom: str = "geom") -> DataFrame:
    """The one geometry type, or Unknown if there are several."""
    t = features.agg(F.min(f"{geom}.type").alias("a"), F.max(f"{geom}.type").alias("b"))
    return t.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("Unknown").alias("geometry"))


def schema_of(features: DataFrame, epsg: int, geom: str = "geom") -> DataFrame:
    """Properties with their types, beside the geometry type and reference system."""
    spark = features.sparkSession
    rows = [(c, t) for c, t in features.dtypes if c != geom]
    return spark.createDataFrame(rows, "property string, type string").join(F.broadcast(geometry_type(features, geom))).withColumn("epsg", F.lit(epsg))


def in_box(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, geom: str = "geom") -> DataFrame:
    """Features whose bounding box meets the closed box; with stored xmin .. ymax columns these filters reach the scan."""
    cols = set(features.columns)
    x0, y0, x1, y1 = (F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")) if {"xmin", "ymin", "xmax", "ymax"} <= cols else G.bounds(F.col(geom))
    return features.filter((x0 <= xmax) & (x1 >= xmin) & (y0 <= ymax) & (y1 >= ymin))


def hilbert(x: Column, y: Column, bounds: tuple[float, float, float, float], level: int = 16) -> Column:
    """Distance along a Hilbert curve of 4 ** level cells over bounds."""
    n = (1 << level) - 1
    scale = lambda v, lo, hi: F.least(F.greatest(F.floor((v - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0) * F.lit(float(n))), F.lit(0)), F.lit(n)).cast("long")
    steps = F.sequence(F.lit(level - 1), F.lit(0), F.lit(-1))
    start = F.struct(scale(x, bounds[0], bounds[2]).alias("x"), scale(y, bounds[1], bounds[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        d = s["d"] + side * side * F.when(rx == 1, 3).otherwise(0).bitwiseXOR(ry)
        fx, fy = F.when((ry == 0) & (rx == 1), n - s["x"]).otherwise(s["x"]), F.when((ry == 0) & (rx == 1), n - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.cast("long").alias("d"))

    return F.aggregate(steps, start, step)["d"]


def morton(x: Column, y: Column, bounds: tuple[float, float, float, float], level: int = 16) -> Column:
    """Interleaved bits of the cell numbers."""
    n = (1 << level) - 1
    scale = lambda v, lo, hi: F.least(F.greatest(F.floor((v - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0) * F.lit(float(n))), F.lit(0)), F.lit(n)).cast("long")
    a, b = scale(x, bounds[0], bounds[2]), scale(y, bounds[1], bounds[3])
    out = F.lit(0).cast("long")
    for k in range(level):
        out = out + F.shiftright(a, k).bitwiseAND(F.lit(1)) * (1 << (2 * k)) + F.shiftright(b, k).bitwiseAND(F.lit(1)) * (1 << (2 * k + 1))
    return out


def spatial_shuffle(features: DataFrame, bounds: tuple[float, float, float, float], by: str = "hilbert", level: int = 16, partitions: int | None = None, geom: str = "geom") -> DataFrame:
    """Range-partitioned and sorted along a space-filling curve, by the vertex mean."""
    x, y = G.vertex_mean(G.vertices(F.col(geom)))
    key = {"hilbert": hilbert, "morton": morton}[by](x, y, bounds, level)
    df = features.withColumn("curve", key)
    return (df.repartitionByRange(partitions, "curve") if partitions else df.repartitionByRange("curve")).sortWithinPartitions("curve")


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Row dicts with a geom struct."""
    if not records:
        raise ValueError("no records")
    if any("geom" not in r for r in records):
        raise ValueError("a record has no geometry")
    return spark.createDataFrame(records, schema)
