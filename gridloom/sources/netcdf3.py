"""NetCDF classic files (CDF-1, CDF-2) in plain Python: numeric variables of fixed or record dimensions, attributes, read and written.

A file is read by one task per variable; cells come out as rows. NetCDF-4 (HDF5) needs a native library and isn't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from ..meta import RasterMeta
from ..operators.cube import Cube

TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    attrs: dict
    dtype: np.dtype
    begin: int = 0
    size: int = 0
    record: bool = False
    data: np.ndarray | None = None


@dataclass
class File:
    dims: dict[str, int] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 4
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise ValueError("not a NetCDF classic file")
        self.offset = ">i" if raw[3] == 1 else ">q"

    def take(self, fmt: str) -> int:
        v = struct.unpack_from(fmt, self.raw, self.at)[0]
        self.at += struct.calcsize(fmt)
        return v

    def name(self) -> str:
        n = self.take(">i")
        s = self.raw[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return s

    def attrs(self) -> dict:
        tag, n, out = self.take(">i"), self.take(">i"), {}
        for _ in range(n if tag else 0):
            key, kind, count = self.name(), self.take(">i"), self.take(">i")
            dt = np.dtype(TYPES[kind])
            size = dt.itemsize * count
            raw = self.raw[self.at : self.at + size]
            self.at += size + -size % 4
            if kind == 2:
                out[key] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                v = np.frombuffer(raw, dt).tolist()
                out[key] = v[0] if count == 1 else v
        return out


def parse(raw: bytes) -> File:
    """Dimensions, attributes and variables (without data) of a file."""
    r = _Reader(raw)
    records = r.take(">i")
    f = File(records=max(records, 0))
    tag, n = r.take(">i"), r.take(">i")
    names = []
    for _ in range(n if tag else 0):
        name = r.name()
        names.append(name)
        f.dims[name] = r.take(">i")
    record = next((k for k, v in f.dims.items() if v == 0), None)
    f.attrs = r.attrs()
    tag, n = r.take(">i"), r.take(">i")
    for _ in range(n if tag else 0):
        name = r.name()
        dims = tuple(names[r.take(">i")] for _ in range(r.take(">i")))
        attrs = r.attrs()
        kind, size, begin = r.take(">i"), r.take(">i"), r.take(r.offset)
        f.variables[name] = Variable(name, dims, attrs, np.dtype(TYPES[kind]), begin, size, bool(dims) and dims[0] == record)
    if record is not None:
        f.dims[record] = f.records
    return f


def values(raw: bytes, f: File, name: str) -> np.ndarray:
    """A variable's data with its dimensions."""
    v = f.variables[name]
    shape = tuple(f.dims[d] for d in v.dims)
    if not v.record:
        return np.frombuffer(raw, v.dtype, int(np.prod(shape, dtype=int)), v.begin).reshape(shape)
    inner = int(np.prod(shape[1:], dtype=int))
    recs = [x for x in f.variables.values() if x.record]
    step = sum(x.size for x in recs) if len(recs) > 1 else inner * v.dtype.itemsize
    return np.stack([np.frombuffer(raw, v.dtype, inner, v.begin + i * step) for i in range(shape[0])]).reshape(shape) if shape[0] else np.empty(shape, v.dtype)


def encode(f: File) -> bytes:
    """A CDF-2 file with fixed dimensions; variables carry their data."""
    def name(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attrs(a: dict) -> bytes:
        if not a:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(a))
        for k, v in a.items():
            if isinstance(v, str):
                kind, body, n = 2, v.encode(), len(v.encode())
            else:
                arr = np.atleast_1d(np.asarray(v))
                arr = arr.astype(">i4" if arr.dtype.kind in "iu" else ">f8")
                kind, body, n = CODES[arr.dtype.str[1:]], arr.tobytes(), arr.size
            out += name(k) + struct.pack(">ii", kind, n) + body + b"\0" * (-len(body) % 4)
        return out

    head = b"CDF\x02" + struct.pack(">i", 0) + (struct.pack(">ii", 10, len(f.dims)) + b"".join(name(k) + struct.pack(">i", n) for k, n in f.dims.items()) if f.dims else struct.pack(">ii", 0, 0)) + attrs(f.attrs)
    order, bodies, entries = list(f.dims), [], []
    for v in f.variables.values():
        data = np.ascontiguousarray(v.data, v.dtype.newbyteorder(">"))
        raw = data.tobytes()
        raw += b"\0" * (-len(raw) % 4)
        bodies.append(raw)
        entries.append((name(v.name) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", order.index(d)) for d in v.dims) + attrs(v.attrs) + struct.pack(">ii", CODES[data.dtype.str[1:]], len(raw))))
    at = len(head) + 8 + sum(len(e) + 8 for e in entries)
    out = head + struct.pack(">ii", 11 if entries else 0, len(entries))
    for e, raw in zip(entries, bodies):
        out += e + struct.pack(">q", at)
        at += len(raw)
    return out + b"".join(bodies)


def geobox(raw: bytes, f: File) -> tuple[RasterMeta, bool]:
    """Grid from the last two dimensions' coordinate variables, and whether rows run north."""
    grids = [v for v in f.variables.values() if len(v.dims) >= 2]
    if not grids:
        raise ValueError("no gridded variable")
    yd, xd = grids[0].dims[-2:]
    axis = lambda d: values(raw, f, d).astype(float) if d in f.variables else np.arange(f.dims[d], dtype=float)
    x, y = axis(xd), axis(yd)
    dx, dy = float(x[1] - x[0]) if len(x) > 1 else 1.0, float(y[1] - y[0]) if len(y) > 1 else -1.0
    north = dy > 0
    top = float(y[-1] if north else y[0]) + abs(dy) / 2
    return RasterMeta(len(y), len(x), float(x[0]) - dx / 2, top, dx, abs(dy)), north


def cells(raw: bytes, f: File, name: str, north: bool) -> Iterator[pa.RecordBatch]:
    """t, variable, band, row, col, value of a variable, unpacked; fill values are null. Leading dimensions are flattened into t."""
    v = f.variables[name]
    a = values(raw, f, name).astype(float)
    fill = v.attrs.get("_FillValue", v.attrs.get("missing_value"))
    bad = np.isnan(a) if fill is None else np.isnan(a) | np.isclose(a, float(fill), rtol=1e-6)
    a = a * float(v.attrs.get("scale_factor", 1.0)) + float(v.attrs.get("add_offset", 0.0))
    a = a.reshape(-1, *a.shape[-2:])
    bad = bad.reshape(a.shape)
    if north:
        a, bad = a[:, ::-1], bad[:, ::-1]
    r, c = np.indices(a.shape[1:], dtype=np.int32)
    for t in range(len(a)):
        n = r.size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, t, np.int32)), pa.array([name] * n), pa.array(np.ones(n, np.int32)), pa.array(r.ravel()), pa.array(c.ravel()), pa.array(a[t].ravel(), mask=bad[t].ravel())],
            names=["t", "variable", "band", "row", "col", "value"],
        )


def read(spark: SparkSession, path: str, variable: str | None = None) -> Cube:
    """All gridded variables of a file (or folder of one file) as a cube; only its header is read on the driver's account."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(path)
    raw = files.select("content").first()[0]
    f = parse(raw)
    meta, north = geobox(raw, f)
    names = [n for n, v in f.variables.items() if len(v.dims) >= 2 and v.dtype.kind in "if" and n not in f.dims and (variable is None or n == variable)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                yield from cells(content, parse(content), name, north)

    per = files.select("content", F.explode(F.array(*map(F.lit, names))).alias("name")).select("name", "content")
    return Cube(per.mapInArrow(work, "t int, variable string, band int, row int, col int, value double"), meta)


def write(cube: Cube, folder: str, steps: int, attrs: dict | None = None) -> None:
    """One CDF-2 file of all variables under folder. A file is one stream, so one task gathers it; large cubes belong in tables."""
    from pyarrow import fs as pafs

    m = cube.meta
    names = sorted(r[0] for r in cube.variable_names().collect())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = {n: np.full((steps, m.rows, m.cols), -9999.0) for n in names}
        for b in batches:
            p = b.to_pandas()
            p = p[p["value"].notna()]
            for n, g in p.groupby("variable"):
                data[n][g["t"], g["row"], g["col"]] = g["value"]
        f = File({"time": steps, "lat": m.rows, "lon": m.cols}, {"Conventions": "CF-1.8"} | (attrs or {}))
        f.variables["time"] = Variable("time", ("time",), {"axis": "T"}, np.dtype("f8"), data=np.arange(steps, dtype=float))
        f.variables["lat"] = Variable("lat", ("lat",), {"units": "degrees_north"}, np.dtype("f8"), data=m.y0 - (np.arange(m.rows) + 0.5) * m.dy)
        f.variables["lon"] = Variable("lon", ("lon",), {"units": "degrees_east"}, np.dtype("f8"), data=m.x0 + (np.arange(m.cols) + 0.5) * m.dx)
        for n in names:
            f.variables[n] = Variable(n, ("time", "lat", "lon"), {"_FillValue": -9999.0}, np.dtype("f8"), data=data[n])
        fs, root = (pafs.LocalFileSystem(), "/" + folder.split(":", 1)[-1].lstrip("/")) if folder.startswith("file:") or "://" not in folder else pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/.cube.tmp", compression=None) as out:
            out.write(encode(f))
        fs.move(f"{root}/.cube.tmp", f"{root}/cube.nc")
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    cube.df.select("variable", "t", "row", "col", "value").repartitionByRange(1, "variable").mapInArrow(work, "done int").collect()
