"""Geometry as structs: STRUCT<type STRING, parts ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>, and expressions over it.

A point is one part of one vertex; lines and polygons have one part (the outer ring is closed); multi-geometries one part for each member.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

XY = "struct<x:double,y:double>"
GEOM = f"struct<type:string,parts:array<array<{XY}>>>"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geom(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))


def point(x: Column, y: Column) -> Column:
    return geom("Point", F.array(F.array(xy(x, y))))


def polygon(ring: Column) -> Column:
    return geom("Polygon", F.array(ring))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed rectangle."""
    return polygon(F.array(xy(x0, y0), xy(x0, y1), xy(x1, y1), xy(x1, y0), xy(x0, y0)))


def close(ring: Column) -> Column:
    """The ring with its first vertex at the end; fewer than three vertices are an error."""
    short = F.raise_error(F.lit("a polygon needs three vertices or more")).cast(f"array<{XY}>")
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.size(ring) < 3, short).otherwise(closed)


def number(x: Column) -> Column:
    """A coordinate as text with up to six decimals and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), number(x), F.lit(" "), number(y), F.lit(")"))


def ring_text(ring: Column) -> Column:
    return F.concat_ws(", ", F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))))


def ring_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), ring_text(ring), F.lit("))"))


def wkt_of(ring: list[tuple[float, float]]) -> str:
    trim = lambda v: f"{v:.6f}".rstrip("0").rstrip(".")
    return "POLYGON ((" + ", ".join(f"{trim(x)} {trim(y)}" for x, y in ring) + "))"


def vertices(g: Column) -> Column:
    return F.flatten(g["parts"])


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def bounds(g: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax."""
    v = vertices(g)
    return F.array_min(xs(v)), F.array_min(ys(v)), F.array_max(xs(v)), F.array_max(ys(v))


def vertex_mean(points: Column) -> tuple[Column, Column]:
    """Mean of the vertices, a repeated closing one included; null without any."""
    n = F.nullif(F.size(points), F.lit(0)).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return total(xs(points)) / n, total(ys(points)) / n


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: points on lower and left edges count as inside, on upper and right ones as outside."""
    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        return F.when((a["y"] > y) != (b["y"] > y), x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"])).otherwise(F.lit(False))

    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(False), lambda s, i: s != crosses(i)))


def contains(g: Column, x: Column, y: Column) -> Column:
    """Whether a point is in any part of a (multi-)polygon."""
    return F.exists(g["parts"], lambda ring: in_ring(ring, x, y))


def shoelace(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])
