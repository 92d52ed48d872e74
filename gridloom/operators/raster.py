"""Rasters as relations of cells: band, row, col, value; null is no data.

Every operator is a plan over (band, row, col): filters reach the scan, joins are equi-joins on cell keys, aggregates are combined
before they are shuffled. Nothing is collected. A raster may be sparse: a missing row means no data wherever values are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G
from ..meta import RasterMeta, isclose

KEY = ["band", "row", "col"]


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    meta: RasterMeta

    # -- making ---------------------------------------------------------------------------------------------------------------

    @staticmethod
    def lattice(spark: SparkSession, meta: RasterMeta, bands: int = 1) -> DataFrame:
        """All cell keys of the grid."""
        n = meta.rows * meta.cols
        i = F.col("id")
        return spark.range(n * bands).select(F.expr(f"CAST(id div {n} AS INT) + 1").alias("band"), F.expr(f"CAST((id % {n}) div {meta.cols} AS INT)").alias("row"), (i % meta.cols).cast("int").alias("col"))

    @staticmethod
    def create(spark: SparkSession, meta: RasterMeta) -> "Raster":
        """A raster without any data."""
        return Raster(Raster.lattice(spark, meta, meta.bands).withColumn("value", F.lit(None).cast("double")), meta)

    @staticmethod
    def from_array(spark: SparkSession, array: np.ndarray, meta: RasterMeta) -> "Raster":
        """A 2-D or 3-D array (bands first) as cells; the sentinel and NaN become null."""
        a = np.asarray(array, float)
        a = a[None] if a.ndim == 2 else a
        b, r, c = (x.ravel() for x in np.indices(a.shape))
        v = a.ravel()
        bad = np.isnan(v) if meta.nodata is None else np.isnan(v) | np.isclose(v, meta.nodata, rtol=1e-3)
        rows = pd.DataFrame({"band": (b + 1).astype("int32"), "row": r.astype("int32"), "col": c.astype("int32"), "value": v, "bad": bad})
        df = spark.createDataFrame(rows, "band int, row int, col int, value double, bad boolean").select("band", "row", "col", F.when(~F.col("bad"), F.col("value")).alias("value"))
        return Raster(df, meta.with_(rows=a.shape[1], cols=a.shape[2], bands=a.shape[0]))

    def with_df(self, df: DataFrame, **meta) -> "Raster":
        return Raster(df.select(*KEY, "value"), self.meta.with_(**meta) if meta else self.meta)

    def like(self, values: DataFrame) -> "Raster":
        """This grid with other values (band, row, col, value)."""
        keys = self.df.select(*KEY)
        return self.with_df(keys.join(values.select(*KEY, "value"), KEY, "left"))

    def to_array(self, band: int = 1) -> np.ndarray:
        """A band as an array (NaN: no data); for small rasters."""
        out = np.full((self.meta.rows, self.meta.cols), np.nan)
        p = self.df.filter((F.col("band") == band) & F.col("value").isNotNull()).toPandas()
        out[p["row"], p["col"]] = p["value"]
        return out

    # -- access ---------------------------------------------------------------------------------------------------------------

    def band(self, i: int) -> "Raster":
        """The i-th band, counted from 0."""
        if not 0 <= i < self.meta.bands:
            raise IndexError(i)
        return self.with_df(self.df.filter(F.col("band") == i + 1))

    def window(self, xoff: int, yoff: int, xsize: int, ysize: int) -> "Raster":
        """Cells of a window with their own rows and columns from 0."""
        m = self.meta
        m.check_window(xoff, yoff, xsize, ysize)
        df = self.df.filter(F.col("row").between(yoff, yoff + ysize - 1) & F.col("col").between(xoff, xoff + xsize - 1))
        df = df.withColumn("row", F.col("row") - yoff).withColumn("col", F.col("col") - xoff)
        return self.with_df(df, rows=ysize, cols=xsize, x0=m.x0 + xoff * m.dx, y0=m.y0 - yoff * m.dy)

    def polygon_window(self, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """(xoff, yoff, xsize, ysize) of a bounding box (xmin, ymin, xmax, ymax); ends are exclusive."""
        m = self.meta
        c0, c1 = int((bounds[0] - m.x0) // m.dx), int((bounds[2] - m.x0) // m.dx)
        r0, r1 = int((m.y0 - bounds[3]) // m.dy), int((m.y0 - bounds[1]) // m.dy)
        return c0, r0, c1 - c0, r1 - r0

    def write(self, patch: DataFrame, row: int, col: int) -> "Raster":
        """Values of patch (band, row, col, value), placed at (row, col); its nulls change nothing."""
        p = patch.select("band", (F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), F.col("value").alias("new"))
        return self.with_df(self.df.join(p, KEY, "left").withColumn("value", F.coalesce("new", "value")))

    def blocks(self, xsize: int, ysize: int) -> DataFrame:
        """Blocks in row-major order: x_offset, y_offset, window_xsize, window_ysize."""
        m, spark = self.meta, self.df.sparkSession
        nx, ny = -(-m.cols // xsize), -(-m.rows // ysize)
        x, y = (F.col("id") % nx * xsize).cast("int"), (F.expr(f"id div {nx}") * ysize).cast("int")
        return spark.range(nx * ny).select(x.alias("x_offset"), y.alias("y_offset"), F.least(F.lit(xsize), F.lit(m.cols) - x).alias("window_xsize"), F.least(F.lit(ysize), F.lit(m.rows) - y).alias("window_ysize"))

    def tiled(self, size: int = 256) -> DataFrame:
        """Cells with tile_row and tile_col."""
        return self.df.withColumn("tile_row", F.expr(f"row div {size}").cast("int")).withColumn("tile_col", F.expr(f"col div {size}").cast("int"))

    def x_dimension(self) -> DataFrame:
        spark = self.df.sparkSession
        return spark.range(self.meta.cols).select(F.col("id").cast("int").alias("col"), self.meta.x_of(F.col("id")).alias("x"))

    def y_dimension(self) -> DataFrame:
        spark = self.df.sparkSession
        return spark.range(self.meta.rows).select(F.col("id").cast("int").alias("row"), self.meta.y_of(F.col("id")).alias("y"))

    def bounds(self) -> DataFrame:
        """The bounding box as one row: xmin, ymin, xmax, ymax and its ring as WKT."""
        b = self.meta.bbox
        ring = [(b[0], b[1]), (b[0], b[3]), (b[2], b[3]), (b[2], b[1]), (b[0], b[1])]
        return self.df.sparkSession.createDataFrame([(*map(float, b), G.wkt_of(ring))], "xmin double, ymin double, xmax double, ymax double, wkt string")

    def coords(self, location: str = "center", domain_only: bool = False) -> DataFrame:
        """row, col, x, y of the cells' centres or upper left corners."""
        at = {"center": 0.5, "corner": 0.0}[location]
        cells = self.df.filter(F.col("band") == 1)
        cells = cells.filter(F.col("value").isNotNull()) if domain_only else cells
        return cells.select("row", "col", self.meta.x_of(F.col("col"), at).alias("x"), self.meta.y_of(F.col("row"), at).alias("y"))

    def points(self, location: str = "center", domain_only: bool = False) -> DataFrame:
        """id (row-major cell number), and the point as struct and WKT."""
        c = self.coords(location, domain_only)
        return c.select(self._id(), G.point(F.col("x"), F.col("y")).alias("geom"), G.point_wkt(F.col("x"), F.col("y")).alias("wkt"))

    def _id(self) -> Column:
        return (F.col("row").cast("long") * self.meta.cols + F.col("col")).alias("id")

    def polygons(self, domain_only: bool = False) -> DataFrame:
        """id and the cell's closed ring as struct and WKT."""
        m = self.meta
        cells = self.df.filter(F.col("band") == 1)
        cells = cells.filter(F.col("value").isNotNull()) if domain_only else cells
        l, r, t, b = m.x_of(F.col("col"), 0), m.x_of(F.col("col"), 1), m.y_of(F.col("row"), 0), m.y_of(F.col("row"), 1)
        ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((l, t), (r, t), (r, b), (l, b), (l, t))))
        return cells.select(self._id(), G.polygon(ring).alias("geom"), G.ring_wkt(ring).alias("wkt"))

    def locate(self, points: DataFrame) -> DataFrame:
        """points (x, y) with row and col of their cell, clamped to the grid."""
        m = self.meta
        clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
        return points.withColumn("row", clamp(m.row_of(F.col("y")), m.rows)).withColumn("col", clamp(m.col_of(F.col("x")), m.cols))

    def map_coordinates(self, cells: DataFrame, center: bool = False) -> DataFrame:
        """cells (row, col) with x and y of the corner or centre."""
        at = 0.5 if center else 0.0
        return cells.withColumn("x", self.meta.x_of(F.col("col"), at)).withColumn("y", self.meta.y_of(F.col("row"), at))

    # -- bands ----------------------------------------------------------------------------------------------------------------

    def add_band(self, values: DataFrame) -> "Raster":
        """values (row, col, value) as a further band."""
        n = self.meta.bands + 1
        new = values.select(F.lit(n).alias("band"), "row", "col", F.col("value").cast("double").alias("value"))
        return self.with_df(self.df.unionByName(new), bands=n)

    def band_names(self, described: DataFrame) -> DataFrame:
        """band, name: the description, else the metadata entry, else Band_<n>. described: band, description, entry."""
        return described.select("band", F.coalesce("description", "entry", F.concat(F.lit("Band_"), F.col("band").cast("string"))).alias("name"))

    def translate(self, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, scale: tuple[float, float, float, float] | None = None, dtype: str | None = None) -> "Raster":
        """Subset of bands (from 1, renumbered in that order), window, linear rescale (from lo, hi to lo, hi), cast."""
        out = self if window is None else self.window(*window)
        df = out.df
        if bands is not None:
            number = F.create_map(*(x for i, b in enumerate(bands, 1) for x in (F.lit(b), F.lit(i))))
            df = df.filter(F.col("band").isin(bands)).withColumn("band", number[F.col("band")])
        if scale is not None:
            a, b, c, d = map(float, scale)
            df = df.withColumn("value", F.lit(c) + (F.col("value") - F.lit(a)) * F.lit((d - c) / (b - a)))
        if dtype is not None:
            df = df.withColumn("value", F.col("value").cast(dtype).cast("double"))
        return out.with_df(df, bands=len(bands) if bands else self.meta.bands, dtype=dtype or self.meta.dtype)

    # -- masks and no data ------------------------------------------------------------------------------------------------------

    def from_sentinel(self, nodata: float, rtol: float = 1e-3) -> "Raster":
        """Sentinel values and NaN become null."""
        v = F.col("value")
        return self.with_df(self.df.withColumn("value", F.when(~isclose(v, nodata, rtol) & ~F.isnan(v), v)), nodata=nodata)

    def to_sentinel(self, nodata: float | None = None) -> DataFrame:
        return self.df.withColumn("value", F.coalesce("value", F.lit(float(self.meta.nodata if nodata is None else nodata))))

    def mask(self, band: int = 0) -> DataFrame:
        """row, col, mask: 255 where there is data, else 0."""
        return self.band(band).df.select("row", "col", F.when(F.col("value").isNull(), 0).otherwise(255).alias("mask"))

    def count_domain(self) -> DataFrame:
        return self.df.groupBy("band").agg(F.count("value").alias("cells"))

    def extract(self, exclude: float | None = None) -> DataFrame:
        """Domain values, without one that is excluded."""
        df = self.df.filter(F.col("value").isNotNull())
        return df if exclude is None else df.filter(~isclose(F.col("value"), exclude))

    def extract_points(self, points: DataFrame) -> DataFrame:
        """points with the value of their cell in every band; points outside are left out."""
        m = self.meta
        at = points.withColumn("row", m.row_of(F.col("y"))).withColumn("col", m.col_of(F.col("x"))).filter(F.col("row").between(0, m.rows - 1) & F.col("col").between(0, m.cols - 1))
        return at.join(self.df, ["row", "col"])

    def fill(self, value: float) -> "Raster":
        """Every domain cell gets the value."""
        return self.with_df(self.df.withColumn("value", F.when(F.col("value").isNotNull(), F.lit(float(value)))))

    def change_nodata(self, stored: DataFrame, old: float | None, new: float) -> DataFrame:
        """stored (band, row, col, value with sentinels): old, or NaN where old is None, becomes new."""
        v = F.col("value")
        hit = F.isnan(v) if old is None else isclose(v, old)
        return stored.withColumn("value", F.when(hit, F.lit(float(new))).otherwise(v))

    # -- cropping ---------------------------------------------------------------------------------------------------------------

    def crop_polygons(self, polygons: DataFrame, trim: bool = True) -> "Raster":
        """Cells whose centre is in a polygon keep their value; outer rows and columns without data are then cut off."""
        from .zonal import labels

        inside = labels(self.meta, polygons).select("row", "col", F.lit(True).alias("inside"))
        out = self.with_df(self.df.join(inside, ["row", "col"], "left").withColumn("value", F.when(F.col("inside"), F.col("value"))))
        return out.trim() if trim else out

    def trim(self) -> "Raster":
        """Without outer rows and columns that hold no data in any band; needs one small job for the extent."""
        e = self.df.filter(F.col("value").isNotNull()).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
        if e[0] is None:
            return self
        return self.window(e[2], e[0], e[3] - e[2] + 1, e[1] - e[0] + 1)

    def drop_empty_lines(self) -> DataFrame:
        """Rows and columns without any data removed, interior ones too; the others are counted anew."""
        full = self.df.filter(F.col("value").isNotNull())
        w = lambda k: Window.orderBy(k)  # noqa: E731  # one row per line
        rows = full.select("row").distinct().withColumn("new_row", F.row_number().over(w("row")) - 1)
        cols = full.select("col").distinct().withColumn("new_col", F.row_number().over(w("col")) - 1)
        return self.df.join(rows, "row").join(cols, "col").select("band", F.col("new_row").cast("int").alias("row"), F.col("new_col").cast("int").alias("col"), "value")

    def crop_raster(self, mask: "Raster", fill_gaps: bool = False) -> "Raster":
        """The mask's no-data layout; both must be on the same grid."""
        if not self.meta.same_grid(mask.meta):
            raise ValueError("the mask is on another grid; align it first")
        m = mask.df.filter(F.col("band") == 1).select("row", "col", F.col("value").alias("m"))
        src = self.fill_gaps(mask) if fill_gaps else self
        return src.with_df(src.df.join(m, ["row", "col"], "left").withColumn("value", F.when(F.col("m").isNotNull(), F.col("value"))))

    def fill_gaps(self, mask: "Raster") -> "Raster":
        """Where the mask has data and this raster none: the first neighbour with data (right, left, up, down, then diagonals)."""
        steps = [(0, 1), (0, -1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]
        gaps = self.df.filter(F.col("value").isNull()).join(mask.df.filter((F.col("band") == 1) & F.col("value").isNotNull()).select("row", "col"), ["row", "col"], "left_semi").select(*KEY)
        offsets = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(steps)))
        near = gaps.withColumn("o", F.explode(offsets)).select("band", F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "o.k")
        got = near.join(self.df.filter(F.col("value").isNotNull()), KEY).groupBy("band", F.col("r0").alias("row"), F.col("c0").alias("col")).agg(F.min_by("value", "k").alias("found"))
        return self.with_df(self.df.join(got, KEY, "left").withColumn("value", F.coalesce("value", "found")))

    # -- aggregates -------------------------------------------------------------------------------------------------------------

    def stats(self, mask: DataFrame | None = None) -> DataFrame:
        """band, min, max, mean, std (population); with polygons as mask only cells whose centre is inside."""
        df = self.df if mask is None else self.crop_polygons(mask, trim=False).df
        v = F.col("value")
        return df.groupBy("band").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))

    def histogram(self, bins: int = 6, low: float | None = None, high: float | None = None, include_out_of_range: bool = False) -> DataFrame:
        """bin, lower, upper, count over half-open bins; values equal to the upper end count only if include_out_of_range (in the last bin)."""
        df = self.df.filter((F.col("band") == 1) & F.col("value").isNotNull()).select("value")
        ends = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(*(F.lit(float(x)).alias(n) if x is not None else F.col(n) for x, n in ((low, "lo"), (high, "hi"))))
        i = F.floor((F.col("value") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))).cast("int")
        if include_out_of_range:
            i = F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1))
        counts = df.join(F.broadcast(ends)).groupBy(i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
        step = (F.col("hi") - F.col("lo")) / F.lit(bins)
        frame = F.broadcast(ends).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))

    def normalize(self) -> "Raster":
        """(value - min) / (max - min) of each band."""
        ends = self.df.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        return self.with_df(self.df.join(F.broadcast(ends), "band").withColumn("value", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))  # one row per band

    def rescale(self, low: float, high: float) -> "Raster":
        return self.with_df(self.df.withColumn("value", (F.col("value") - F.lit(float(low))) / F.lit(float(high - low))))

    def overlay(self, classes: "Raster", exclude: float | None = None) -> DataFrame:
        """class, value of every cell with data in both; same grid only. Group it for lists or statistics."""
        if not self.meta.same_grid(classes.meta):
            raise ValueError("the class raster is on another grid")
        c = classes.df.filter(F.col("band") == 1).select("row", "col", F.col("value").cast("long").alias("class"))
        return self.extract(exclude).join(c, ["row", "col"]).filter(F.col("class").isNotNull()).select("class", "band", "value")

    # -- to rows and UDFs ---------------------------------------------------------------------------------------------------------

    def to_features(self, polygons: DataFrame | None = None, geometry: str | None = None) -> DataFrame:
        """One row per cell that has data in every band: row, col, Band_1 ..., with its point or polygon on request."""
        src = self if polygons is None else self.crop_polygons(polygons, trim=False)
        names = list(self.meta.band_names) or [f"Band_{i}" for i in range(1, self.meta.bands + 1)]
        wide = src.df.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == i, F.col("value"))).alias(n) for i, n in enumerate(names, 1))).dropna(subset=names)
        m = self.meta
        if geometry == "point":
            wide = wide.withColumn("wkt", G.point_wkt(m.x_of(F.col("col")), m.y_of(F.col("row"))))
        elif geometry == "polygon":
            l, r, t, b = m.x_of(F.col("col"), 0), m.x_of(F.col("col"), 1), m.y_of(F.col("row"), 0), m.y_of(F.col("row"), 1)
            wide = wide.withColumn("wkt", G.ring_wkt(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((l, t), (r, t), (r, b), (l, b), (l, t))))))
        return wide

    def to_xyz(self) -> DataFrame:
        """x, y and one column per band of the cells that have data in every band."""
        m = self.meta
        wide = self.to_features()
        names = [c for c in wide.columns if c not in ("row", "col")]
        return wide.select(m.x_of(F.col("col")).alias("x"), m.y_of(F.col("row")).alias("y"), *names)

    def apply(self, func: Callable[[np.ndarray], np.ndarray]) -> "Raster":
        """A vectorised function on domain cells; no data stays."""
        udf = F.pandas_udf(lambda s: pd.Series(np.asarray(func(s.to_numpy()), float)), "double")
        return self.with_df(self.df.withColumn("value", F.when(F.col("value").isNotNull(), udf(F.coalesce("value", F.lit(1.0))))))

    def map_blocks(self, func: Callable[[np.ndarray], np.ndarray], size: int = 256) -> "Raster":
        """func on each tile as a 2-D array (NaN: no data) of the same shape."""
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            r0, c0 = pdf["row"].min(), pdf["col"].min()
            a = np.full((pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1), np.nan)
            a[pdf["row"] - r0, pdf["col"] - c0] = pdf["value"]
            out = np.asarray(func(a), float)
            return pdf[KEY].assign(value=out[pdf["row"] - r0, pdf["col"] - c0])

        got = self.tiled(size).groupBy("band", "tile_row", "tile_col").applyInPandas(work, "band int, row int, col int, value double")
        return self.with_df(got.withColumn("value", F.when(~F.isnan("value"), F.col("value"))))
