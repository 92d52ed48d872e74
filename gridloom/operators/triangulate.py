"""Linear interpolation over a Delaunay triangulation (Bowyer-Watson) of scattered points.

Points are triangulated in tiles with a margin: one task a tile. A triangle counts only if its circumcircle lies inside the points that the task
looked at, for then no other point can change it. Tiles with cells that no such triangle covers are done again with four times the margin, until
the margin takes in all points; cells outside of all points' convex hull need none. The result doesn't depend on tiles or margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..meta import RasterMeta
from ..sources.shared import store


def delaunay(p: np.ndarray, scale: float | None = None) -> list[tuple[int, int, int]]:
    """Triangles (numbers of points) of distinct points. Points on a common circle are told apart by shifts of scale * 1e-9 that follow from their coordinates."""
    n = len(p)
    centre, span = p.mean(0), float(np.ptp(p, axis=0).max() or 1.0)
    h = np.sin(p @ np.array([[12.9898, 39.346], [78.233, 11.135]])) * 43758.5453
    q = np.vstack([p + (h - np.floor(h) - 0.5) * (span if scale is None else scale) * 1e-9, centre + span * np.array([[-40, -30], [40, -30], [0, 50]])])
    size, m = 64, 1
    corners, circles, live = np.zeros((size, 3), int), np.zeros((size, 3)), np.zeros(size, bool)
    corners[0], circles[0], live[0] = (n, n + 1, n + 2), _circle(q, (n, n + 1, n + 2)), True
    for i in range(n):
        c = circles[:m]
        bad = np.flatnonzero(live[:m] & ((q[i, 0] - c[:, 0]) ** 2 + (q[i, 1] - c[:, 1]) ** 2 < c[:, 2]))
        edges: dict[tuple[int, int], int] = {}
        for t in corners[bad].tolist():
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                e = (min(a, b), max(a, b))
                edges[e] = edges.get(e, 0) + 1
        live[bad] = False
        free = bad.tolist()
        for (a, b), k in edges.items():
            if k == 1:
                if free:
                    at = free.pop()
                else:
                    at, m = m, m + 1
                    if m > size:
                        corners, circles, live = (np.concatenate([x, np.zeros_like(x)]) for x in (corners, circles, live))
                        size *= 2
                corners[at], circles[at], live[at] = (a, b, i), _circle(q, (a, b, i)), True
    return [tuple(t) for t in corners[:m][live[:m]].tolist() if max(t) < n]


def _circle(q: np.ndarray, t: tuple[int, int, int]) -> tuple[float, float, float]:
    (ax, ay), (bx, by), (cx, cy) = q[list(t)]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if d == 0:
        return 0.0, 0.0, float("inf")
    x = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
    y = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
    return x, y, (ax - x) ** 2 + (ay - y) ** 2


def interpolate(points: np.ndarray, values: np.ndarray, at: np.ndarray, window: tuple[float, float, float, float] | None = None, scale: float | None = None) -> np.ndarray:
    """Barycentric interpolation at positions; NaN outside of all triangles, and in those whose circumcircle leaves the window (x0, y0, x1, y1)."""
    out = np.full(len(at), np.nan)
    if len(points) < 3:
        return out
    for t in delaunay(points, scale):
        a, b, c = points[list(t)]
        m = np.array([b - a, c - a]).T
        if abs(np.linalg.det(m)) < 1e-14:
            continue
        if window is not None:
            x, y, r2 = _circle(points, t)
            r = np.sqrt(r2)
            if not (x - r >= window[0] and y - r >= window[1] and x + r <= window[2] and y + r <= window[3]):
                continue
        w = (at - a) @ np.linalg.inv(m).T
        hit = (w[:, 0] >= -1e-9) & (w[:, 1] >= -1e-9) & (w.sum(1) <= 1 + 1e-9) & np.isnan(out)
        v = values[list(t)]
        out[hit] = v[0] + w[hit, 0] * (v[1] - v[0]) + w[hit, 1] * (v[2] - v[0])
    return out


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in counter-clockwise order."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for seq in (p.tolist(), p[::-1].tolist()):
        side: list[list[float]] = []
        for x, y in seq:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (y - side[-2][1]) - (side[-1][1] - side[-2][1]) * (x - side[-2][0]) <= 0:
                side.pop()
            side.append([x, y])
        sides += side[:-1]
    return np.array(sides)


def _hulls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = np.empty((0, 2))
    for pdf in parts:
        held = hull(np.concatenate([held, pdf[["x", "y"]].to_numpy()]))
    yield pd.DataFrame({"x": held[:, 0], "y": held[:, 1]})


def linear_grid(points: DataFrame, meta: RasterMeta, tile: int = 64, margin: int = 16) -> DataFrame:
    """row, col, value of the cells inside the triangulation of points (x, y, value); points at one place count as their mean.

    Work goes by tiles of `tile` cells; margin is the number of cells around that are looked at first. Null coordinates and values don't count.
    """
    spark = points.sparkSession
    points = points.select("x", "y", "value").dropna()
    corners = hull(points.select("x", "y").mapInPandas(_hulls, "x double, y double").toPandas().to_numpy(float).reshape(-1, 2))  # the hulls of partitions
    if len(corners) < 3:
        return spark.createDataFrame([], "row int, col int, value double")
    low, high = corners.min(0), corners.max(0)
    scale = float((high - low).max())
    one = store(points.groupBy("x", "y").agg(F.avg("value").alias("value")))
    r, c = meta.row_of(F.col("y")), meta.col_of(F.col("x"))
    rows, cols = -(-meta.rows // tile), -(-meta.cols // tile)
    reach = max(meta.rows * meta.dy, meta.cols * meta.dx) + max(abs(low[0] - meta.x0), abs(high[0] - meta.x0), abs(low[1] - meta.y0), abs(high[1] - meta.y0))
    todo, done = spark.range(rows * cols).select(F.expr(f"CAST(id div {cols} AS INT)").alias("tr"), (F.col("id") % cols).cast("int").alias("tc")), None
    def of_margin(margin: int, last: bool):
        def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tr, tc = key
            rr, cc = np.mgrid[tr * tile : min((tr + 1) * tile, meta.rows), tc * tile : min((tc + 1) * tile, meta.cols)]
            at = np.stack([meta.x0 + (cc.ravel() + 0.5) * meta.dx, meta.y0 - (rr.ravel() + 0.5) * meta.dy], 1)
            window = (meta.x0 + (tc * tile - margin) * meta.dx, meta.y0 - ((tr + 1) * tile + margin) * meta.dy, meta.x0 + ((tc + 1) * tile + margin) * meta.dx, meta.y0 - (tr * tile - margin) * meta.dy)
            pdf = pdf.sort_values(["x", "y"])
            v = interpolate(pdf[["x", "y"]].to_numpy(), pdf["value"].to_numpy(), at, None if last else window, scale)
            inside = np.ones(len(at), bool)
            for a, b in zip(corners, np.roll(corners, -1, 0)):
                inside &= (b[0] - a[0]) * (at[:, 1] - a[1]) - (b[1] - a[1]) * (at[:, 0] - a[0]) >= -1e-9 * scale * scale
            whole = last or not (inside & np.isnan(v)).any()
            keep = inside & ~np.isnan(v) if whole else np.zeros(len(at), bool)
            # a row of -1 tells that the tile is done
            return pd.DataFrame({"row": [*rr.ravel()[keep], *([-1] * int(whole))], "col": [*cc.ravel()[keep], *([-1] * int(whole))], "value": [*v[keep], *([0.0] * int(whole))], "tr": tr, "tc": tc}).astype({"row": "int32", "col": "int32", "tr": "int32", "tc": "int32"})

        return work

    while True:
        last = margin * min(meta.dx, meta.dy) > reach

        span = lambda v, n: F.sequence(F.greatest(F.floor((v - margin) / tile), F.lit(0)), F.least(F.floor((v + margin) / tile), F.lit(n - 1)))  # noqa: B023, E731
        near = one.filter(r.between(-margin, rows * tile + margin) & c.between(-margin, cols * tile + margin)).withColumn("tr", F.explode(span(r, rows))).withColumn("tc", F.explode(span(c, cols)))
        near = near.withColumn("tr", F.col("tr").cast("int")).withColumn("tc", F.col("tc").cast("int")).join(todo, ["tr", "tc"], "left_semi")
        found = store(near.groupBy("tr", "tc").applyInPandas(of_margin(margin, last), "row int, col int, value double, tr int, tc int"))
        cells = found.filter("row >= 0").select("row", "col", "value")
        done = cells if done is None else done.unionByName(cells)
        todo = store(todo.join(found.filter("row < 0").select("tr", "tc"), ["tr", "tc"], "left_anti"))
        if last or not todo.limit(1).count():
            return done
        margin *= 4
