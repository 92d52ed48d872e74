"""Georeferencing of a raster and the column expressions that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

NODATA = -9999.0


def isclose(a: Column, b: float, rtol: float = 1e-3, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|, false for null."""
    return F.coalesce(F.abs(a - F.lit(float(b))) <= F.lit(atol + rtol * abs(b)), F.lit(False))


@dataclass(frozen=True)
class RasterMeta:
    """Grid of rows x cols cells; (x0, y0) is the outer corner of cell (0, 0), rows go down."""

    rows: int
    cols: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    epsg: int = 4326
    nodata: float | None = NODATA
    bands: int = 1
    dtype: str = "double"
    band_names: tuple[str, ...] = ()
    colors: dict[int, str] = field(default_factory=dict, hash=False)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return (self.x0, self.y0 - self.rows * self.dy, self.x0 + self.cols * self.dx, self.y0)

    @property
    def corner(self) -> tuple[float, float]:
        return (self.x0, self.y0)

    @property
    def geotransform(self) -> tuple[float, float, float, float, float, float]:
        return (self.x0, self.dx, 0.0, self.y0, 0.0, -self.dy)

    def same_grid(self, other: "RasterMeta") -> bool:
        return (self.rows, self.cols, self.x0, self.y0, self.dx, self.dy, self.epsg) == (other.rows, other.cols, other.x0, other.y0, other.dx, other.dy, other.epsg)

    def with_(self, **changes) -> "RasterMeta":
        return replace(self, **changes)

    def x_of(self, col: Column, at: float = 0.5) -> Column:
        """x of a column's centre (at 0.5) or left edge (at 0)."""
        return F.lit(float(self.x0)) + (col.cast("double") + F.lit(at)) * F.lit(float(self.dx))

    def y_of(self, row: Column, at: float = 0.5) -> Column:
        return F.lit(float(self.y0)) - (row.cast("double") + F.lit(at)) * F.lit(float(self.dy))

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(float(self.x0))) / F.lit(float(self.dx))).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(float(self.y0)) - y) / F.lit(float(self.dy))).cast("int")

    def check_window(self, xoff: int, yoff: int, xsize: int, ysize: int) -> None:
        if xoff < 0 or yoff < 0 or xsize < 1 or ysize < 1 or xoff + xsize > self.cols or yoff + ysize > self.rows:
            raise IndexError(f"window {(xoff, yoff, xsize, ysize)} is outside of {self.rows} x {self.cols} cells")
