"""Invariants and fixtures of grids, features and formats."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.functions import crs, geometry as G
from gridloom.meta import RasterMeta
from gridloom.operators import cluster, focal, resample
from gridloom.operators.raster import Raster
from gridloom.operators.neighbours import nearest
from gridloom.operators.triangulate import interpolate, linear_grid
from gridloom.operators.zonal import zonal_stats
from gridloom.sources import geotiff


@pytest.fixture(scope="module")
def grid10(spark):
    return Raster.from_array(spark, np.arange(100.0).reshape(10, 10), RasterMeta(10, 10, y0=10.0))


def boxes(spark, *rows):
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(rows)], "zone int, x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("geom", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def test_zonal_means_and_empty_zones(spark, grid10):
    got = {r["zone"]: r for r in zonal_stats(grid10, boxes(spark, (0, 8, 2, 10), (2, 8, 4, 10), (50, 50, 60, 60))).collect()}
    assert (got[0]["mean"], got[1]["mean"]) == (np.mean([0, 1, 10, 11]), np.mean([2, 3, 12, 13]))
    assert (got[2]["count"], got[2]["sum"], got[2]["mean"]) == (0, 0.0, None)


def test_last_polygon_wins(spark, grid10):
    zones = boxes(spark, (0, 8, 4, 10), (2, 8, 4, 10))
    assert {r["zone"]: r["count"] for r in zonal_stats(grid10, zones).collect()} == {0: 4, 1: 4}
    assert {r["zone"]: r["count"] for r in zonal_stats(grid10, zones, overlap="all").collect()} == {0: 8, 1: 4}


def test_focal_of_a_constant_and_slope_of_a_ramp(spark):
    const = Raster.from_array(spark, np.full((5, 5), 7.0), RasterMeta(5, 5, y0=5.0))
    assert np.allclose(focal.focal_mean(const, 2).to_array(), 7) and np.allclose(focal.focal_std(const).to_array(), 0)
    ramp = Raster.from_array(spark, np.tile(np.arange(5.0), (5, 1)), RasterMeta(5, 5, y0=5.0))
    assert np.allclose(focal.slope(ramp).to_array(), 45)
    assert np.allclose(focal.aspect(ramp).to_array(), 270)


def test_same_size_is_identity_and_crop_is_part(spark, grid10):
    assert np.array_equal(resample.resample(grid10, 1.0).to_array(), grid10.to_array())
    assert np.allclose(resample.resample(grid10, 1.0, "cubic").to_array(), grid10.to_array())
    part = grid10.crop_polygons(boxes(spark, (2, 3, 6, 8)))
    assert part.meta.bbox == (2.0, 3.0, 6.0, 8.0) and np.array_equal(part.to_array(), grid10.to_array()[2:7, 2:6])


def test_clusters_against_flood_fill(spark):
    a = (np.random.default_rng(3).random((23, 31)) > 0.6).astype(float)
    r = Raster.from_array(spark, a, RasterMeta(23, 31, y0=23.0))
    got = {(x["row"], x["col"]): x["cluster"] for x in cluster.cluster(r, 1, 1, tile=7).collect()}
    label, want = 0, {}
    for i in range(23):
        for j in range(31):
            if a[i, j] and (i, j) not in want:
                label += 1
                todo = [(i, j)]
                while todo:
                    p = todo.pop()
                    if p in want or not (0 <= p[0] < 23 and 0 <= p[1] < 31) or not a[p]:
                        continue
                    want[p] = label
                    todo += [(p[0] + x, p[1] + y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    assert got == want


def test_outlines_with_a_hole(spark):
    a = np.zeros((5, 5))
    a[0:3, 0:3] = 4
    a[1, 1] = 0
    r = Raster.from_array(spark, a, RasterMeta(5, 5, y0=5.0))
    rows = cluster.outlines(cluster.regions(r, tile=2), r).collect()
    assert len(rows) == 1 and rows[0]["cells"] == 8 and rows[0]["wkt"].count("(") == 3


def test_sentinels_and_windows(spark):
    r = Raster.from_array(spark, np.array([[1.0, -9999.0], [np.nan, 4.0]]), RasterMeta(2, 2, y0=2.0))
    assert r.df.filter("value IS NULL").count() == 2
    with pytest.raises(IndexError):
        r.window(1, 1, 2, 1)


def test_geotiff_codecs(spark):
    a = np.arange(600.0).reshape(1, 20, 30)
    a[0, 3, 4] = np.nan
    t = geotiff.Tiff(geotiff.encode(a, RasterMeta(20, 30, 5.0, 9.0, 0.5, 0.25, 32633), tile=16))
    m = t.meta()
    assert (m.rows, m.cols, m.x0, m.y0, m.dx, m.dy, m.epsg, m.nodata) == (20, 30, 5.0, 9.0, 0.5, 0.25, 32633, -9999.0)
    out = np.zeros((20, 30))
    for _, r0, c0, b in t.blocks():
        out[r0 : r0 + b.shape[0], c0 : c0 + b.shape[1]] = b[:, :, 0]
    assert np.array_equal(out, np.where(np.isnan(a[0]), -9999, a[0]))
    assert geotiff.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@settings(max_examples=60, deadline=None)
@given(st.floats(-2.9, 2.9), st.floats(-70, 70), st.sampled_from([3857, 32631, 32731]))
def test_reference_systems_round_trip(dlon, lat, epsg):
    x, y = crs.transform(3 + dlon, lat, 4326, epsg, crs.Floats)
    lon2, lat2 = crs.transform(x, y, epsg, 4326, crs.Floats)
    assert math.isclose(lon2, 3 + dlon, abs_tol=1e-8) and math.isclose(lat2, lat, abs_tol=1e-8)


def test_known_projected_points():
    assert np.allclose(crs.transform(5.0, 50.0, 4326, 3035, crs.Floats), (3962799.451, 2999718.853), atol=0.01)
    with pytest.raises(ValueError):
        crs.transform(0.0, 0.0, 4326, 2154, crs.Floats)


def test_linear_interpolation_is_exact_on_planes():
    rng = np.random.default_rng(1)
    p = rng.random((40, 2))
    at = rng.random((30, 2)) * 0.5 + 0.25
    got = interpolate(p, p @ [2.0, -3.0] + 1, at)
    assert np.allclose(got[~np.isnan(got)], (at @ [2.0, -3.0] + 1)[~np.isnan(got)]) and (~np.isnan(got)).mean() > 0.9


def test_linear_grid_does_not_depend_on_tiles(spark):
    at = lambda m: [(m.x0 + (c + 0.5) * m.dx, m.y0 - (r + 0.5) * m.dy) for r in range(m.rows) for c in range(m.cols)]
    wide = RasterMeta(200, 200, x0=0.0, y0=200.0)
    corners = spark.createDataFrame([(x, y, 2 * x - y) for x in (0.0, 200.0) for y in (0.0, 200.0)] + [(None, 1.0, 2.0)], "x double, y double, value double")
    got = linear_grid(corners, wide).toPandas()
    assert len(got) == 40_000 and np.allclose(got["value"], 2 * (got["col"] + 0.5) - (199.5 - got["row"]))
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((40, 2)) * [12, 60], rng.random((25, 2)) * 60])  # dense to the left, sparse to the right
    v = rng.random(len(p))
    m = RasterMeta(60, 60, x0=0.0, y0=60.0)
    want = interpolate(p[np.lexsort((p[:, 1], p[:, 0]))], v[np.lexsort((p[:, 1], p[:, 0]))], np.array(at(m))).reshape(60, 60)
    points = spark.createDataFrame([(float(x), float(y), float(z)) for (x, y), z in zip(p, v)], "x double, y double, value double")
    for tile, margin in ((16, 2), (60, 16)):
        out = np.full((60, 60), np.nan)
        for r in linear_grid(points, m, tile, margin).collect():
            out[r["row"], r["col"]] = r["value"]
        assert np.allclose(out, want, atol=1e-6, equal_nan=True)
    assert linear_grid(points.limit(2), m).count() == 0


def test_nearest_within_more_than_a_cell(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "point_id long, x double, y double")
    s = spark.createDataFrame([(7, 4.0, 0.0), (8, 0.0, -4.5), (9, 9.0, 0.0)], "elem_id int, x double, y double")
    got = {(r["point_id"], r["elem_id"], r["distance"]) for r in nearest(p, s, 2, cell=1.0, within=5.0).collect()}
    assert got == {(1, 7, 4.0), (1, 8, 4.5)}
    assert [r["elem_id"] for r in nearest(p, s, 1, cell=1.0).orderBy("point_id").collect()] == [7, 9]


def test_focal_radius_beyond_a_tile(spark):
    ones = Raster.from_array(spark, np.ones((60, 60)), RasterMeta(60, 60, y0=60.0))
    for tile in (4, 7, 60):
        got = focal.focal_apply(ones, lambda w: np.nansum(w, axis=1), 10, tile).to_array()
        assert got.shape == (60, 60) and (got == 441).all()


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from gridloom.sources.shared import shared_folder

    cluster_session = N(conf=N(get=lambda k, d: None), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(cluster_session)
    assert shared_folder(N(conf=N(get=lambda k, d: "hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"
