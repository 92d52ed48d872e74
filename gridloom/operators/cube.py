"""Time stacks and variables: cells with t and variable (t, variable, band, row, col, value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..meta import RasterMeta, isclose
from .raster import Raster

CELL = ["variable", "band", "row", "col"]
REDUCERS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop}


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    meta: RasterMeta

    def with_df(self, df: DataFrame) -> "Cube":
        return Cube(df, self.meta)

    @staticmethod
    def from_raster(raster: Raster, length: int, variable: str = "value") -> "Cube":
        """length equal steps of a template."""
        df = raster.df.withColumn("variable", F.lit(variable)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
        return Cube(df.select("t", *CELL, "value"), raster.meta)

    @staticmethod
    def stack(rasters: list[Raster], variable: str = "value") -> "Cube":
        """Rasters as steps in that order; the grid is the first one's."""
        from functools import reduce

        parts = [r.df.select(F.lit(t).alias("t"), F.lit(variable).alias("variable"), "band", "row", "col", "value") for t, r in enumerate(rasters)]
        return Cube(reduce(DataFrame.unionByName, parts), rasters[0].meta)

    # -- selection ------------------------------------------------------------------------------------------------------------

    def step(self, i: int) -> Raster:
        return Raster(self.df.filter(F.col("t") == i).select("band", "row", "col", "value"), self.meta)

    def length(self) -> DataFrame:
        return self.df.agg(F.count_distinct("t").alias("steps"))

    def _last(self) -> int:
        return self.df.agg(F.max("t")).first()[0] or 0

    def head(self, n: int = 5) -> "Cube":
        return self.with_df(self.df.filter(F.col("t") < n))

    def tail(self, n: int = -5) -> "Cube":
        """The last |n| steps."""
        return self.with_df(self.df.filter(F.col("t") > self._last() - abs(n)))

    def first(self) -> Raster:
        return self.step(0)

    def last(self) -> Raster:
        return self.step(self._last())

    def steps(self, start: int, stop: int) -> "Cube":
        """Half-open range of steps."""
        return self.with_df(self.df.filter((F.col("t") >= start) & (F.col("t") < stop)))

    def replace(self, t: int, raster: Raster) -> "Cube":
        names = [r[0] for r in self.df.select("variable").distinct().limit(2).collect()]
        new = raster.df.select(F.lit(t).alias("t"), F.lit(names[0] if names else "value").alias("variable"), "band", "row", "col", "value")
        return self.with_df(self.df.filter(F.col("t") != t).unionByName(new))

    def sel(self, coords: DataFrame | None = None, value=None, values: list | None = None, start=None, stop=None) -> "Cube":
        """Steps by coordinate: one value, a list, or the closed range start .. stop. coords: t, coord (default: t itself)."""
        df = self.df if coords is None else self.df.join(coords, "t")
        c = F.col("t") if coords is None else F.col("coord")
        if values is not None:
            hit = c.isin(values)
        elif start is not None or stop is not None:
            hit = (c >= F.lit(start) if start is not None else F.lit(True)) & (c <= F.lit(stop) if stop is not None else F.lit(True))
        else:
            hit = c == F.lit(value)
        return self.with_df(df.filter(hit).select("t", *CELL, "value"))

    # -- reductions -----------------------------------------------------------------------------------------------------------

    def reduce(self, how: str, skipna: bool = True) -> DataFrame:
        """Per-cell reduction over time; skipna=False: null where any step is."""
        v = F.col("value")
        agg = REDUCERS[how](v)
        if not skipna:
            agg = F.when(F.count(F.lit(1)) == F.count(v), agg)
        return self.df.groupBy(*CELL).agg(agg.alias("value"))

    def groupby(self, labels: DataFrame, how: str, skipna: bool = True) -> DataFrame:
        """Per-cell reduction over the steps of each label. labels: t, label; small, so that it is broadcast by its size."""
        v = F.col("value")
        agg = REDUCERS[how](v)
        if not skipna:
            agg = F.when(F.count(F.lit(1)) == F.count(v), agg)
        return self.df.join(labels, "t").groupBy("label", *CELL).agg(agg.alias("value"))

    # -- variables ------------------------------------------------------------------------------------------------------------

    def variable(self, name: str) -> "Cube":
        return self.with_df(self.df.filter(F.col("variable") == name))

    def group(self, path: str) -> "Cube":
        """Variables below a group path, without it."""
        return self.with_df(self.df.filter(F.col("variable").startswith(path + "/")).withColumn("variable", F.expr(f"substring(variable, {len(path) + 2})")))

    def variable_names(self) -> DataFrame:
        return self.df.select("variable").distinct()

    def add(self, other: "Cube") -> "Cube":
        """Union of variables; a name that is taken gets -new."""
        taken = self.df.select("variable").distinct().withColumn("taken", F.lit(True))
        new = other.df.join(taken, "variable", "left").withColumn("variable", F.when(F.col("taken"), F.concat("variable", F.lit("-new"))).otherwise(F.col("variable")))
        return self.with_df(self.df.unionByName(new.select(*self.df.columns)))

    def remove(self, name: str) -> "Cube":
        return self.with_df(self.df.filter(F.col("variable") != name))

    def rename(self, old: str, new: str) -> "Cube":
        if self.df.filter(F.col("variable") == new).limit(1).count():
            raise ValueError(f"there is a variable {new}")
        return self.with_df(self.df.withColumn("variable", F.when(F.col("variable") == old, new).otherwise(F.col("variable"))))

    def set(self, name: str, raster: Raster, t: int = 0) -> "Cube":
        """Puts a raster in the place of a variable, or adds it."""
        new = raster.df.select(F.lit(t).alias("t"), F.lit(name).alias("variable"), "band", "row", "col", "value")
        return self.remove(name).with_df(self.remove(name).df.unionByName(new))

    # -- cell operators by step and variable ----------------------------------------------------------------------------------

    def each(self, operation: Callable[[Raster], Raster]) -> "Cube":
        """A raster operator on every step and variable at once: the extra keys ride in band (t, variable, band are packed by name)."""
        keys = self.df.select("t", "variable", "band").distinct().withColumn("k", F.xxhash64("t", "variable", "band"))
        packed = self.df.withColumn("k", F.xxhash64("t", "variable", "band"))
        out = operation(Raster(packed.select(F.col("k").alias("band"), "row", "col", "value"), self.meta))
        df = out.df.withColumnRenamed("band", "k").join(keys, "k").select("t", *CELL, "value")
        return Cube(df, out.meta)

    def unpack(self, scale: float | None, offset: float | None) -> "Cube":
        v = F.col("value") * F.lit(1.0 if scale is None else float(scale)) + F.lit(0.0 if offset is None else float(offset))
        return self.with_df(self.df.withColumn("value", v))

    def flip(self) -> "Cube":
        """South-up rows turned north-up."""
        return self.with_df(self.df.withColumn("row", F.lit(self.meta.rows - 1) - F.col("row")))

    def apply(self, func: Callable[[np.ndarray], np.ndarray]) -> "Cube":
        udf = F.pandas_udf(lambda s: pd.Series(np.asarray(func(s.to_numpy()), float)), "double")
        return self.with_df(self.df.withColumn("value", F.when(F.col("value").isNotNull(), udf(F.coalesce("value", F.lit(1.0))))))

    def overlay(self, classes: Raster, exclude: float | None = None) -> DataFrame:
        """t, class, value of all steps."""
        c = classes.df.filter(F.col("band") == 1).select("row", "col", F.col("value").cast("long").alias("class"))
        df = self.df.filter(F.col("value").isNotNull())
        df = df if exclude is None else df.filter(~isclose(F.col("value"), exclude))
        return df.join(c, ["row", "col"]).filter(F.col("class").isNotNull()).select("t", "class", "value")

    def merge(self, latest_wins: bool = True) -> DataFrame:
        """Mosaic: of the steps that have data in a cell the last (or first) one's value."""
        pick = F.max_by if latest_wins else F.min_by
        return self.df.filter(F.col("value").isNotNull()).groupBy(*CELL).agg(pick("value", "t").alias("value"))

    def rollup(self, *keys: str) -> DataFrame:
        """Statistics over all prefixes of the keys."""
        v = F.col("value")
        return self.df.rollup(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
