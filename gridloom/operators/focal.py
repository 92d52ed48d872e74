"""Neighbourhoods: box filters with mirrored edges, terrain, arbitrary window functions.

Box filters are separable: one window along each row, one along each column, over a table that has the mirrored border cells in it, so
each cell is read twice whatever the radius. Work is spread by row and then by column.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .raster import KEY, Raster


def mirrored(raster: Raster, radius: int, value: Column | None = None) -> DataFrame:
    """Cells with their mirror images (half-sample symmetric) within radius outside of the grid."""
    m = raster.meta
    if radius > min(m.rows, m.cols):
        raise ValueError("the radius is larger than the grid")

    def images(c: Column, n: int) -> Column:
        return F.filter(F.array(c, F.when(c < radius, -1 - c), F.when(c >= n - radius, 2 * n - 1 - c)), lambda x: x.isNotNull())

    df = raster.df.select(*KEY, (F.col("value") if value is None else value).alias("value"))
    return df.withColumn("row", F.explode(images(F.col("row"), m.rows))).withColumn("col", F.explode(images(F.col("col"), m.cols)))


def _box(raster: Raster, radius: int) -> DataFrame:
    """band, row, col, mean over the window's cells with data."""
    m, r = raster.meta, radius
    across = Window.partitionBy("band", "row").orderBy("col").rangeBetween(-r, r)
    down = Window.partitionBy("band", "col").orderBy("row").rangeBetween(-r, r)
    p = mirrored(raster, r).withColumn("s", F.sum("value").over(across)).withColumn("n", F.count("value").over(across))
    p = p.filter(F.col("col").between(0, m.cols - 1))
    p = p.withColumn("s", F.sum("s").over(down)).withColumn("n", F.sum("n").over(down)).filter(F.col("row").between(0, m.rows - 1))
    return p.select(*KEY, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"))


def focal_mean(raster: Raster, radius: int = 1) -> Raster:
    """Mean of the (2 radius + 1)² window, over cells with data."""
    return raster.with_df(_box(raster, radius).withColumnRenamed("mean", "value"))


def focal_std(raster: Raster, radius: int = 1) -> Raster:
    """Root of the box mean of squared deviations, each cell's from its own box mean (two chained filters)."""
    dev = raster.df.join(_box(raster, radius), KEY).withColumn("value", (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    return raster.with_df(_box(raster.with_df(dev), radius).withColumn("value", F.sqrt("mean")))


def focal_apply(raster: Raster, func: Callable[[np.ndarray], np.ndarray], radius: int = 1, tile: int = 256) -> Raster:
    """func on the flattened windows (cells x window size, NaN: no data) of every cell, by tiles with a halo of mirrored cells."""
    m, r = raster.meta, radius
    halo = lambda c: F.sequence(F.floor((c - r) / tile).cast("int"), F.floor((c + r) / tile).cast("int"))  # all tiles whose halo has the cell
    cells = mirrored(raster, r).withColumn("tr", F.explode(halo(F.col("row")))).withColumn("tc", F.explode(halo(F.col("col"))))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, tr, tc = key
        r0, c0 = tr * tile, tc * tile
        r1, c1 = min(r0 + tile, m.rows), min(c0 + tile, m.cols)
        if r0 < 0 or c0 < 0 or r1 <= r0 or c1 <= c0:
            return pd.DataFrame({"band": [], "row": [], "col": [], "value": []})
        a = np.full((r1 - r0 + 2 * r, c1 - c0 + 2 * r), np.nan)
        keep = (pdf["row"] >= r0 - r) & (pdf["row"] < r1 + r) & (pdf["col"] >= c0 - r) & (pdf["col"] < c1 + r)
        p = pdf[keep]
        a[p["row"] - r0 + r, p["col"] - c0 + r] = p["value"]
        win = np.lib.stride_tricks.sliding_window_view(a, (2 * r + 1, 2 * r + 1)).reshape(-1, (2 * r + 1) ** 2)
        rr, cc = np.mgrid[r0:r1, c0:c1]
        return pd.DataFrame({"band": band, "row": rr.ravel(), "col": cc.ravel(), "value": np.asarray(func(win), float)})

    out = cells.groupBy("band", "tr", "tc").applyInPandas(work, "band int, row int, col int, value double")
    return raster.with_df(out.withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


def gradient(raster: Raster) -> DataFrame:
    """band, row, col, gx (per column step), gy (per row step): central differences, one-sided at the edges of the grid."""
    m = raster.meta

    def along(key: str, other: str, n: int, size: float) -> Column:
        w = Window.partitionBy("band", other).orderBy(key)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        v = F.col("value")
        return F.when(F.col(key) == 0, (after - v) / size).when(F.col(key) == n - 1, (v - before) / size).otherwise((after - before) / (2 * size))

    return raster.df.withColumn("gx", along("col", "row", m.cols, m.dx)).withColumn("gy", along("row", "col", m.rows, m.dy)).select(*KEY, "gx", "gy")


def slope(raster: Raster, units: str = "degrees") -> Raster:
    s = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return raster.with_df(gradient(raster).withColumn("value", F.degrees(s) if units == "degrees" else s))


def aspect(raster: Raster) -> Raster:
    """Degrees clockwise from north: (450 - deg(atan2(gy, -gx))) mod 360."""
    a = F.lit(450.0) - F.degrees(F.atan2(F.col("gy"), -F.col("gx")))
    return raster.with_df(gradient(raster).withColumn("value", F.pmod(a, F.lit(360.0))))


def hillshade(raster: Raster, azimuth: float = 315.0, altitude: float = 45.0) -> Raster:
    """255 * (sin alt cos slope + cos alt sin slope cos(azimuth - aspect)), within 0 and 255."""
    az, alt = float(np.radians(360.0 - azimuth + 90.0)), float(np.radians(altitude))
    g = gradient(raster)
    s = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    a = F.atan2(F.col("gy"), -F.col("gx"))
    v = F.lit(255.0) * (F.lit(float(np.sin(alt))) * F.cos(s) + F.lit(float(np.cos(alt))) * F.sin(s) * F.cos(F.lit(az) - a))
    return raster.with_df(g.withColumn("value", F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))))
