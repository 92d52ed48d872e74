"""Connected regions of a raster, their outlines, and footprints.

Tiles are labelled by themselves (one task each, union-find over their cells), then tile borders are joined and the few labels that meet there are
merged by least labels with pointer jumping; no task sees more than a tile, and iterations touch borders only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import ranked, store
from .raster import Raster


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 and edges (a, b) the least node of each component: roots hook onto lesser ones, then all paths are halved until flat."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, low = a[open_], b[open_], np.minimum(x, y)[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], low)
        while not np.array_equal(up := label[label], label):
            label = up


def _label_tile(pdf: pd.DataFrame, cols: int, eight: bool) -> pd.DataFrame:
    """Labels of a tile's cells, which come sorted by row and column."""
    r, c, g = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["g"].to_numpy()
    r0, c0 = r.min(), c.min()
    at = np.full((r.max() - r0 + 2, c.max() - c0 + 3), -1)  # a border where steps may look
    at[r - r0 + 1, c - c0 + 1] = np.arange(len(r))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for dr, dc in ((0, -1), (-1, 0), (-1, -1), (-1, 1)) if eight else ((0, -1), (-1, 0)):
        j = at[r - r0 + 1 + dr, c - c0 + 1 + dc]
        i = np.flatnonzero(j >= 0)
        i = i[g[i] == g[j[i]]]
        ends.append((i, j[i]))
    label = least_labels(len(r), np.concatenate([i for i, _ in ends]), np.concatenate([j for _, j in ends]))
    return pd.DataFrame({"row": r, "col": c, "g": g, "label": r[label].astype("int64") * cols + c[label]})


def components(cells: DataFrame, cols: int, eight: bool = True, tile: int = 256) -> DataFrame:
    """cells (row, col, g): g of equal neighbours makes them one region. Adds label, the region's least row * cols + col."""
    tiles = cells.withColumn("tr", F.expr(f"row div {tile}")).withColumn("tc", F.expr(f"col div {tile}"))
    local = tiles.groupBy("tr", "tc").applyInPandas(lambda pdf: _label_tile(pdf.sort_values(["row", "col"]).reset_index(drop=True), cols, eight), "row int, col int, g double, label long")
    local = store(local)
    edge = local.filter((F.col("row") % tile == 0) | (F.col("row") % tile == tile - 1) | (F.col("col") % tile == 0) | (F.col("col") % tile == tile - 1))
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    near = edge.withColumn("o", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))))
    near = near.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("g").alias("g1"), F.col("label").alias("a"))
    links = near.join(edge.withColumnRenamed("label", "b"), ["row", "col"]).filter((F.col("g1") == F.col("g")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    both = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")))
    while True:
        low = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("bl")), "b").groupBy("a").agg(F.min("bl").alias("n"))
        step = labels.join(low, "a").select("a", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        jump = step.join(labels.select(F.col("a").alias("l"), F.col("l").alias("up")), "l").select("a", "old", F.least("l", "up").alias("l"))
        new = store(jump)
        changed = new.filter("old <> l").limit(1).count()
        labels = new.select("a", "l")
        if not changed:
            break
    return local.join(labels.select(F.col("a").alias("label"), "l"), "label", "left").select("row", "col", "g", F.coalesce("l", "label").alias("label"))


def cluster(raster: Raster, low: float, high: float, band: int = 0, tile: int = 256) -> DataFrame:
    """row, col, value, cluster: 8-connected regions of values within [low, high], numbered from 1 in the order of their first cell."""
    cells = raster.band(band).df.filter(F.col("value").between(low, high))
    lab = components(cells.select("row", "col", F.lit(1.0).alias("g")), raster.meta.cols, True, tile)
    number = ranked(lab.select("label").distinct(), "label", "number").select("label", (F.col("number") + 1).alias("cluster"))
    return cells.select("row", "col", "value").join(lab.select("row", "col", "label"), ["row", "col"]).join(number, "label").select("row", "col", "value", "cluster")


def regions(raster: Raster, band: int = 0, tile: int = 256) -> DataFrame:
    """row, col, value, label: 4-connected regions of equal, non-zero values."""
    cells = raster.band(band).df.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    return components(cells.select("row", "col", F.col("value").alias("g")), raster.meta.cols, False, tile).withColumnRenamed("g", "value")


def outlines(cells: DataFrame, raster: Raster) -> DataFrame:
    """value, label, cells, rings: the closed rings of each region in map coordinates, from the sides that no two of its cells share."""
    m = raster.meta
    r, c = F.col("row"), F.col("col")
    side = lambda r0, c0, r1, c1: F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    sides = cells.select("label", "value", F.explode(F.array(side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1), side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c))).alias("s"))
    key = F.when(F.struct("s.r0", "s.c0") < F.struct(F.col("s.r1").alias("r0"), F.col("s.c1").alias("c0")), F.array("s.r0", "s.c0", "s.r1", "s.c1")).otherwise(F.array("s.r1", "s.c1", "s.r0", "s.c0"))
    open_sides = sides.groupBy("label", "value", key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")).filter("n = 1").select("label", "value", "s.*")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple, list[tuple]] = {}
        for a in zip(pdf["r0"], pdf["c0"], pdf["r1"], pdf["c1"]):
            after.setdefault(a[:2], []).append(a[2:])
        rings = []
        while after:
            start = at = min(after)
            ring, before = [at], None
            while True:
                options = after[at]
                if len(options) > 1 and before is not None:  # at a touching corner turn right, so rings don't cross
                    d = (at[0] - before[0], at[1] - before[1])
                    options.sort(key=lambda p: (p[0] - at[0], p[1] - at[1]) != (d[1], -d[0]))
                nxt = options.pop(0)
                if not options:
                    del after[at]
                before, at = at, nxt
                ring.append(at)
                if at == start:
                    break
            keep = [p for i, p in enumerate(ring) if i in (0, len(ring) - 1) or (ring[i - 1][0] != ring[i + 1][0] and ring[i - 1][1] != ring[i + 1][1])]
            rings.append("(" + ", ".join(f"{m.x0 + x * m.dx:g} {m.y0 - y * m.dy:g}" for y, x in keep) + ")")
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "value": [pdf["value"].iloc[0]], "wkt": ["POLYGON (" + ", ".join(rings) + ")"]})

    rings = open_sides.groupBy("label", "value").applyInPandas(trace, "label long, value double, wkt string")
    return rings.join(cells.groupBy("label").agg(F.count(F.lit(1)).alias("cells")), "label")


def footprint(raster: Raster, band: int = 0, exclude: list[float] | None = None, tile: int = 256) -> DataFrame:
    """Outlines of the 4-connected regions that have data (excluded values count as none)."""
    cells = raster.band(band).df.filter(F.col("value").isNotNull())
    if exclude:
        cells = cells.filter(~F.col("value").isin(exclude))
    lab = components(cells.select("row", "col", F.lit(2.0).alias("g")), raster.meta.cols, False, tile).withColumnRenamed("g", "value")
    return outlines(lab, raster)
