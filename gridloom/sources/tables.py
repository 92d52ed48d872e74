"""Rasters, cubes, features and meshes as Parquet with a sidecar row of metadata."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..meta import RasterMeta
from ..operators.cube import Cube
from ..operators.mesh import Mesh
from ..operators.raster import Raster


def _put_meta(spark: SparkSession, meta: RasterMeta, path: str, mode: str) -> None:
    spark.createDataFrame([(json.dumps(dataclasses.asdict(meta)),)], "meta string").coalesce(1).write.mode(mode).json(f"{path}/meta")


def _get_meta(spark: SparkSession, path: str) -> RasterMeta:
    d = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()[0])
    return RasterMeta(**d | {"band_names": tuple(d["band_names"]), "colors": {int(k): v for k, v in d["colors"].items()}})


def write_raster(raster: Raster, path: str, tile: int = 256, mode: str = "error") -> None:
    """Cells by band, clustered by tile inside files, so that windows prune row groups."""
    cells = raster.tiled(tile).repartitionByRange("band", "tile_row", "tile_col").sortWithinPartitions("band", "tile_row", "tile_col", "row", "col")
    cells.drop("tile_row", "tile_col").write.mode(mode).partitionBy("band").parquet(f"{path}/cells")
    _put_meta(raster.df.sparkSession, raster.meta, path, mode)


def read_raster(spark: SparkSession, path: str) -> Raster:
    df = spark.read.schema("row int, col int, value double, band int").parquet(f"{path}/cells")
    return Raster(df.select("band", "row", "col", "value"), _get_meta(spark, path))


def write_cube(cube: Cube, path: str, mode: str = "error") -> None:
    """One folder per step."""
    cube.df.repartition("t").write.mode(mode).partitionBy("t").parquet(f"{path}/cells")
    _put_meta(cube.df.sparkSession, cube.meta, path, mode)


def read_cube(spark: SparkSession, path: str) -> Cube:
    df = spark.read.schema("variable string, band int, row int, col int, value double, t int").parquet(f"{path}/cells")
    return Cube(df.select("t", "variable", "band", "row", "col", "value"), _get_meta(spark, path))


def write_features(features: DataFrame, path: str, mode: str = "error", geom: str = "geom") -> None:
    """With bounding box columns, which box filters are pushed down on."""
    x0, y0, x1, y1 = G.bounds(F.col(geom))
    features.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}).write.mode(mode).option("compression", "snappy").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_mesh(mesh: Mesh, path: str, mode: str = "error") -> None:
    mesh.nodes.write.mode(mode).parquet(f"{path}/nodes")
    mesh.faces.write.mode(mode).parquet(f"{path}/faces")
    if mesh.values is not None:
        mesh.values.write.mode(mode).partitionBy("variable").parquet(f"{path}/values")


def read_mesh(spark: SparkSession, path: str, with_values: bool = False) -> Mesh:
    values = spark.read.parquet(f"{path}/values") if with_values else None
    return Mesh(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/faces"), values)


def read_cubes(spark: SparkSession, paths: list[str], steps: int, preprocess=None) -> Cube:
    """Cubes of `steps` steps each, one after the other along time; preprocess is applied to each."""
    from functools import reduce

    parts = [read_cube(spark, p) for p in paths]
    parts = [preprocess(p) for p in parts] if preprocess else parts
    dfs = [p.df.withColumn("t", (F.col("t") + i * steps).cast("int")) for i, p in enumerate(parts)]
    return Cube(reduce(DataFrame.unionByName, dfs), parts[0].meta)
