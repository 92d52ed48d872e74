"""The metadata model of datacubes: dimensions, variables, attributes; JSON round trips; data types; writer options."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Dimension:
    name: str
    size: int
    kind: str = ""
    values: list[float] | None = None
    attrs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class VariableInfo:
    name: str
    dtype: str
    dims: list[str]
    attrs: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    nodata: float | None = None


@dataclass(frozen=True)
class Metadata:
    driver: str
    attrs: dict[str, str] = field(default_factory=dict)
    dimensions: list[Dimension] = field(default_factory=list)
    variables: list[VariableInfo] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Metadata":
        d = json.loads(text)
        return Metadata(d["driver"], d["attrs"], [Dimension(**x) for x in d["dimensions"]], [VariableInfo(**x) for x in d["variables"]])

    def names(self) -> list[str]:
        """Dimension names in order."""
        return [d.name for d in self.dimensions]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per variable."""
        rows = [(v.name, v.dtype, v.dims, v.attrs, v.unit, v.nodata) for v in self.variables]
        return spark.createDataFrame(rows, "name string, dtype string, dims array<string>, attrs map<string,string>, unit string, nodata double")


def set_attribute(attrs: Column, name: str, value: str) -> Column:
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != name), F.create_map(F.lit(name), F.lit(value)))


def delete_attribute(attrs: Column, name: str) -> Column:
    """Without the attribute; a name that isn't there changes nothing."""
    return F.map_filter(attrs, lambda k, v: k != name)


#: Raster data types -> Spark types; unsigned ones are widened.
SPARK_TYPES = {"byte": "short", "uint8": "short", "int8": "byte", "uint16": "int", "int16": "short", "uint32": "long", "int32": "int", "uint64": "decimal(20,0)", "int64": "long", "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}
NODATA_LIMITS = {"uint8": (0, 255), "byte": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "uint64": (0, 2**64 - 1), "int64": (-(2**63), 2**63 - 1)}


def fitting_nodata(value: float | None, dtype: str) -> float:
    """A no-data value that the type can hold: unsigned types without one take their maximum, values out of range become -9999 (or the maximum)."""
    if dtype not in NODATA_LIMITS:
        return -9999.0 if value is None else float(value)
    lo, hi = NODATA_LIMITS[dtype]
    if value is None:
        return hi if lo == 0 else -9999
    return value if lo <= value <= hi else (-9999 if lo <= -9999 else hi)


#: Formats by extension.
FORMATS = {"tif": "geotiff", "tiff": "geotiff", "asc": "asciigrid", "nc": "netcdf3", "geojson": "geojson", "json": "geojson", "parquet": "parquet", "zip": "archive", "tar": "archive", "gz": "archive"}


def format_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise ValueError(f"no format for {path}")
    return FORMATS[ext]


def merge_options(defaults: dict[str, object], extra: dict[str, object] | None) -> dict[str, object]:
    """Case-insensitive union; extra wins."""
    out = {k.upper(): v for k, v in defaults.items()}
    return out | {k.upper(): v for k, v in (extra or {}).items()}


def option_list(options: dict[str, object]) -> list[str]:
    """KEY=VALUE texts; booleans are YES and NO, None is left out."""
    text = lambda v: ("YES" if v else "NO") if isinstance(v, bool) else str(v)
    return [f"{k.upper()}={text(v)}" for k, v in options.items() if v is not None]


def check_blocksize(n: int) -> int:
    """A power of two within 64 .. 4096."""
    if not 64 <= n <= 4096 or n & (n - 1):
        raise ValueError(f"{n} isn't a power of two within 64 and 4096")
    return n


def check_keys(options: dict[str, object], known: set[str]) -> None:
    bad = sorted(k for k in options if k.upper() not in known)
    if bad:
        raise ValueError(f"unknown options: {bad}")
