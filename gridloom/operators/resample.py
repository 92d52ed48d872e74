"""Resampling, alignment, reprojection, overviews and mosaics. Every target cell finds its source cells by index arithmetic and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import crs
from ..meta import RasterMeta
from .raster import KEY, Raster


def _bands(raster: Raster) -> DataFrame:
    return raster.df.select("band").distinct()


def _targets(raster: Raster, meta: RasterMeta) -> DataFrame:
    """Keys of the target grid for every band of the source (bands are few: one row each)."""
    spark = raster.df.sparkSession
    return Raster.lattice(spark, meta).drop("band").join(F.broadcast(_bands(raster)))


def _nearest(raster: Raster, targets: DataFrame, x: Column, y: Column) -> DataFrame:
    """targets with the value of the source cell that holds (x, y)."""
    m = raster.meta
    at = targets.withColumn("sr", m.row_of(y)).withColumn("sc", m.col_of(x))
    src = raster.df.select("band", F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return at.join(src, ["band", "sr", "sc"], "left").drop("sr", "sc")


def _weight(method: str, d: Column) -> Column:
    """Kernel weight at distance d (in cells): linear, or cubic convolution with a = -0.5."""
    a = F.abs(d)
    if method == "bilinear":
        return F.greatest(F.lit(1.0) - a, F.lit(0.0))
    near = (F.lit(1.5) * a - F.lit(2.5)) * a * a + F.lit(1.0)
    far = ((F.lit(-0.5) * a + F.lit(2.5)) * a - F.lit(4.0)) * a + F.lit(2.0)
    return F.when(a <= 1, near).when(a < 2, far).otherwise(F.lit(0.0))


def _kernel(raster: Raster, targets: DataFrame, x: Column, y: Column, method: str) -> DataFrame:
    """Weighted mean of the 4 (bilinear) or 16 (cubic) cells around (x, y); weights of cells without data or outside are shared out."""
    m, taps = raster.meta, range(0, 2) if method == "bilinear" else range(-1, 3)
    fx, fy = (x - F.lit(m.x0)) / F.lit(m.dx) - F.lit(0.5), (F.lit(m.y0) - y) / F.lit(m.dy) - F.lit(0.5)
    offs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in taps for j in taps))
    t = targets.withColumn("fx", fx).withColumn("fy", fy).withColumn("o", F.explode(offs))
    t = t.withColumn("sr", (F.floor("fy") + F.col("o.i")).cast("int")).withColumn("sc", (F.floor("fx") + F.col("o.j")).cast("int"))
    src = raster.df.filter(F.col("value").isNotNull()).select("band", F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    w = _weight(method, F.col("fx") - F.col("sc")) * _weight(method, F.col("fy") - F.col("sr"))
    got = t.join(src, ["band", "sr", "sc"]).withColumn("w", w).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("value")).alias("a"), F.sum("w").alias("b"))
    got = got.select(*KEY, F.when(F.abs("b") > 1e-9, F.col("a") / F.col("b")).alias("value"))
    return targets.select(*KEY).join(got, KEY, "left")


def sample(raster: Raster, meta: RasterMeta, method: str = "nearest", transform=None) -> Raster:
    """raster on another grid. transform maps (x, y) columns of the target to the source's coordinates (default: the same)."""
    targets = _targets(raster, meta)
    x, y = meta.x_of(F.col("col")), meta.y_of(F.col("row"))
    if transform is not None:
        x, y = transform(x, y)
    df = _nearest(raster, targets, x, y) if method == "nearest" else _kernel(raster, targets, x, y, method)
    return Raster(df.select(*KEY, "value"), meta.with_(bands=raster.meta.bands))


def resample(raster: Raster, cell: float, method: str = "nearest") -> Raster:
    """Another cell size from the same corner; sizes are rounded half to even."""
    m = raster.meta
    return sample(raster, m.with_(rows=round(m.rows * m.dy / cell), cols=round(m.cols * m.dx / cell), dx=float(cell), dy=float(cell)), method)


def align(raster: Raster, to: RasterMeta, method: str = "nearest") -> Raster:
    """raster on the grid of another one, through its reference system where that differs."""
    if raster.meta.epsg == to.epsg:
        return sample(raster, to, method)
    return sample(raster, to, method, lambda x, y: crs.transform(x, y, to.epsg, raster.meta.epsg))


def to_crs(raster: Raster, epsg: int, method: str = "nearest", keep_shape: bool = False) -> Raster:
    """Reprojected to a grid with square cells that covers the source's edge (21 points a side) and has about as many cells."""
    m = raster.meta
    x0, y0, x1, y1 = crs.project_bounds(m.bbox, m.epsg, epsg)
    size = ((x1 - x0) * (y1 - y0) / (m.rows * m.cols)) ** 0.5
    rows, cols = (m.rows, m.cols) if keep_shape else (max(1, round((y1 - y0) / size)), max(1, round((x1 - x0) / size)))
    grid = RasterMeta(rows, cols, x0, y1, (x1 - x0) / cols if keep_shape else size, (y1 - y0) / rows if keep_shape else size, epsg, m.nodata)
    return sample(raster, grid, method, lambda x, y: crs.transform(x, y, epsg, m.epsg))


def convert_longitude(raster: Raster) -> Raster:
    """Columns of 0 .. 360 degrees rolled to -180 .. 180."""
    m = raster.meta
    if m.x0 + (m.cols - 0.5) * m.dx <= 180:
        raise ValueError("longitudes don't pass 180 degrees")
    k = round(180 / m.dx)
    return raster.with_df(raster.df.withColumn("col", F.pmod(F.col("col") - k, F.lit(m.cols)).cast("int")), x0=m.x0 - 180)


def overview(raster: Raster, factor: int, method: str = "nearest") -> Raster:
    """One level of a pyramid: blocks of factor x factor cells by their first cell, or by average, mode, rms, min, max, sum, median."""
    m, v = raster.meta, F.col("value")
    agg = {
        "nearest": F.min_by(v, F.struct("row", "col")), "average": F.avg(v), "mode": F.mode(v, deterministic=True), "rms": F.sqrt(F.avg(v * v)),
        "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "med": F.median(v),
    }[method]
    df = raster.df if method == "nearest" else raster.df.filter(v.isNotNull())
    cells = df.groupBy("band", F.expr(f"row div {factor}").cast("int").alias("r"), F.expr(f"col div {factor}").cast("int").alias("c")).agg(agg.alias("value"))
    meta = m.with_(rows=-(-m.rows // factor), cols=-(-m.cols // factor), dx=m.dx * factor, dy=m.dy * factor)
    return Raster(cells.select("band", F.col("r").alias("row"), F.col("c").alias("col"), "value"), meta)


def overviews(raster: Raster, levels: list[int] | None = None, method: str = "nearest") -> DataFrame:
    """All levels (powers of two by default, down to one tile of 256 or fewer cells): level, band, row, col, value."""
    from functools import reduce

    if levels is None:
        levels, f = [], 2
        while max(raster.meta.rows, raster.meta.cols) // f >= 1 and len(levels) < 6:
            levels.append(f)
            f *= 2
    bad = [f for f in levels if f < 2 or f & (f - 1)]
    if bad:
        raise ValueError(f"not powers of two: {bad}")
    return reduce(DataFrame.unionByName, [overview(raster, f, method).df.withColumn("level", F.lit(f)) for f in levels])


def mosaic(rasters: list[Raster], meta: RasterMeta | None = None) -> Raster:
    """One raster of several: the last one with data in a cell wins. The grid is the union in the first one's cells."""
    from functools import reduce

    m = rasters[0].meta
    if meta is None:
        b = [r.meta.bbox for r in rasters]
        x0, y0, x1, y1 = min(t[0] for t in b), min(t[1] for t in b), max(t[2] for t in b), max(t[3] for t in b)
        meta = m.with_(rows=round((y1 - y0) / m.dy), cols=round((x1 - x0) / m.dx), x0=x0, y0=y1)
    parts = []
    for k, r in enumerate(rasters):
        df = r.df.filter(F.col("value").isNotNull())
        parts.append(df.select("band", meta.row_of(r.meta.y_of(F.col("row"))).alias("row"), meta.col_of(r.meta.x_of(F.col("col"))).alias("col"), "value", F.lit(k).alias("k")))
    one = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.max_by("value", "k").alias("value"))
    keys = Raster.lattice(rasters[0].df.sparkSession, meta, m.bands)
    return Raster(keys.join(one, KEY, "left"), meta)
