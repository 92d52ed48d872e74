"""GeoJSON: collections, or one feature per line (which is split between tasks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import XY

RING = f"array<{XY}>"


def _pair(p: Column) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def _parts(kind: Column, text: Column) -> Column:
    """The coordinates' JSON text as parts: for polygons the outer rings."""
    c = lambda schema: F.from_json(text, schema)
    one, many, rings, polygons = (c("array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    ring = lambda r: F.transform(r, _pair)
    out = F.when(kind == "Point", F.array(F.array(_pair(one)))).when(kind == "LineString", F.array(ring(many))).when(kind == "MultiPoint", F.transform(many, lambda p: F.array(_pair(p))))
    out = out.when(kind == "Polygon", F.array(ring(rings[0]))).when(kind == "MultiLineString", F.transform(rings, ring))
    return out.when(kind == "MultiPolygon", F.transform(polygons, lambda q: ring(q[0])))


FEATURE = "type string, properties string, geometry struct<type:string,coordinates:string>"


def read(spark: SparkSession, path: str, properties: str, collection: bool = False) -> DataFrame:
    """Properties (a schema) and geom of each feature. collection: whole files, else a feature per line."""
    if collection:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<struct<{FEATURE.replace('type string, properties string, geometry ', 'type:string,properties:string,geometry:')}>>").alias("c"))
        rows = raw.select(F.explode("c.features").alias("f"))
    else:
        rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.from_json("value", FEATURE).alias("f"))
    g = F.col("f.geometry")
    geom = F.struct(g["type"].alias("type"), _parts(g["type"], g["coordinates"]).alias("parts"))
    return rows.select(F.from_json("f.properties", properties).alias("p"), F.when(g.isNotNull(), geom).alias("geom")).select("p.*", "geom")


def feature_lines(features: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature per row, as text."""
    xy = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, xy)
    parts, kind = F.col(f"{geom}.parts"), F.col(f"{geom}.type")
    coords = F.when(kind == "Point", F.to_json(F.struct(xy(parts[0][0]).alias("c")))).when(kind.isin("LineString"), F.to_json(F.struct(ring(parts[0]).alias("c"))))
    coords = coords.when(kind == "MultiPoint", F.to_json(F.struct(F.transform(parts, lambda p: xy(p[0])).alias("c")))).when(kind.isin("Polygon", "MultiLineString"), F.to_json(F.struct(F.transform(parts, ring).alias("c"))))
    coords = coords.when(kind == "MultiPolygon", F.to_json(F.struct(F.transform(parts, lambda p: F.array(ring(p))).alias("c"))))
    body = F.regexp_extract(coords, r'^\{"c":(.*)\}$', 1)
    props = F.to_json(F.struct(*(c for c in features.columns if c != geom)))
    return features.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}}")).alias("value"))


def write(features: DataFrame, path: str, mode: str = "error", geom: str = "geom") -> None:
    feature_lines(features, geom).write.mode(mode).text(path)
