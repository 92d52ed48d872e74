"""GeoTIFF in plain Python: strips or tiles; no, deflate or LZW compression; read by a Spark data source, a task per file and tile row."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from ..meta import RasterMeta
from ..operators.raster import Raster

SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW."""
    out, bits, have, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    before = b""
    while True:
        while have < width and at < len(data):
            bits, have, at = (bits << 8) | data[at], have + 8, at + 1
        if have < width:
            return bytes(out)
        code, have = bits >> (have - width), have - width
        bits &= (1 << have) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, before = table[:258], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


class Tiff:
    """Tags of the first image of a file's bytes, and its blocks."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.e = {b"II": "<", b"MM": ">"}[raw[:2]]
        if struct.unpack_from(self.e + "H", raw, 2)[0] != 42:
            raise ValueError("not a classic TIFF")
        at = struct.unpack_from(self.e + "I", raw, 4)[0]
        self.tags: dict[int, tuple] = {}
        for i in range(struct.unpack_from(self.e + "H", raw, at)[0]):
            tag, kind, n = struct.unpack_from(self.e + "HHI", raw, at + 2 + 12 * i)
            size = struct.calcsize(self.e + SIZES[kind]) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(self.e + "I", raw, at + 10 + 12 * i)[0]
            self.tags[tag] = (raw[where : where + n],) if kind == 2 else struct.unpack_from(self.e + SIZES[kind] * n, raw, where)
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.cols, self.rows, self.bands = one(256), one(257), one(277, 1)
        self.dtype = np.dtype(f"{self.e}{KINDS[one(339, 1)]}{one(258, 8) // 8}")
        self.compression, self.predictor, self.planar = one(259, 1), one(317, 1), one(284, 1)
        self.tiled = 322 in self.tags
        self.block = (one(323), one(322)) if self.tiled else (min(one(278, self.rows), self.rows), self.cols)
        self.offsets, self.counts = self.tags[324 if self.tiled else 273], self.tags[325 if self.tiled else 279]

    def meta(self) -> RasterMeta:
        sx, sy = self.tags.get(33550, (1.0, 1.0))[:2]
        tie = self.tags.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
        keys = self.tags.get(34735, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        nodata = self.tags.get(42113)
        return RasterMeta(self.rows, self.cols, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy, found.get(3072) or found.get(2048) or 4326, float(nodata[0].split(b"\0")[0]) if nodata else None, self.bands)

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """band (from 0, or -1 for all), first row, first column, array (rows, cols, bands)."""
        h, w = self.block
        across, down = -(-self.cols // w), -(-self.rows // h)
        deep = self.bands if self.planar == 1 else 1
        for i, (at, n) in enumerate(zip(self.offsets, self.counts)):
            band, k = (-1, i) if self.planar == 1 else divmod(i, across * down)
            r0, c0 = k // across * h, k % across * w
            high = h if self.tiled else min(h, self.rows - r0)
            data = self.raw[at : at + n]
            if self.compression in (8, 32946):
                data = zlib.decompress(data)
            elif self.compression == 5:
                data = lzw(data)
            elif self.compression != 1:
                raise ValueError(f"TIFF compression {self.compression} isn't supported")
            a = np.frombuffer(data, self.dtype, high * w * deep).reshape(high, w, deep)
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=self.dtype)
            elif self.predictor != 1:
                raise ValueError(f"TIFF predictor {self.predictor} isn't supported")
            yield band, r0, c0, a[: self.rows - r0, : self.cols - c0]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("content").to_pylist():
            t = Tiff(raw)
            for band, r0, c0, a in t.blocks():
                for k in range(a.shape[2]):
                    r, c = np.indices(a.shape[:2], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(r.size, (k if band < 0 else band) + 1, np.int32)), pa.array((r + r0).ravel()), pa.array((c + c0).ravel()), pa.array(a[:, :, k].ravel().astype("float64"))], names=["band", "row", "col", "value"])


def read(spark: SparkSession, path: str) -> Raster:
    """One file (or a folder with one file). Its bytes are decoded block by block in a task; for stacks of files there is a task per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    head = files.select("content").first()[0]
    meta = Tiff(head).meta()
    raster = Raster(files.select("content").mapInArrow(_decode, "band int, row int, col int, value double"), meta)
    return raster.from_sentinel(meta.nodata) if meta.nodata is not None else raster


def encode(arrays: np.ndarray, meta: RasterMeta, tile: int = 256) -> bytes:
    """A tiled, deflated GeoTIFF of doubles (bands, rows, cols); NaN is written as the sentinel."""
    bands, rows, cols = arrays.shape
    a = np.where(np.isnan(arrays), meta.nodata if meta.nodata is not None else np.nan, arrays)
    across, down = -(-cols // tile), -(-rows // tile)
    full = np.full((bands, down * tile, across * tile), 0.0)
    full[:, :rows, :cols] = a
    blocks = [zlib.compress(np.ascontiguousarray(full[:, r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].transpose(1, 2, 0)).astype("<f8").tobytes()) for r in range(down) for c in range(across)]
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if meta.epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if meta.epsg == 4326 else 3072, 0, 1, meta.epsg)
    tags: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (64,) * bands), (259, 3, (8,)), (262, 3, (1,)), (277, 3, (bands,)), (284, 3, (1,)), (322, 4, (tile,)), (323, 4, (tile,)),
        (324, 4, (0,) * len(blocks)), (325, 4, tuple(map(len, blocks))), (339, 3, (3,) * bands), (33550, 12, (meta.dx, meta.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0)), (34735, 3, keys),
    ]
    if meta.nodata is not None:
        tags.append((42113, 2, f"{meta.nodata!r}".encode() + b"\0"))

    def pack(kind: int, v) -> bytes:
        return v if isinstance(v, bytes) else struct.pack("<" + SIZES[kind] * len(v), *v)

    start = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(p) + len(p) % 2 for p in (pack(k, v) for _, k, v in tags) if len(p) > 4)
    at, offsets = start + extra, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags = [(t, k, tuple(offsets) if t == 324 else v) for t, k, v in tags]
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for t, k, v in tags:
        p = pack(k, v)
        if len(p) <= 4:
            where = p.ljust(4, b"\0")
        else:
            where = struct.pack("<I", start + len(tail))
            tail += p + b"\0" * (len(p) % 2)
        head += struct.pack("<HHI", t, k, len(v)) + where
    return head + b"\0\0\0\0" + tail + b"".join(blocks)


def write(raster: Raster, folder: str, tile: int = 256) -> None:
    """One GeoTIFF under folder. A file is one stream, so one task gathers the raster; for large rasters write tables or a file per tile."""
    meta = raster.meta
    bands = [int(r[0]) for r in raster.df.select("band").distinct().orderBy("band").collect()]
    number = {b: i for i, b in enumerate(bands)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        a = np.full((len(bands), meta.rows, meta.cols), np.nan)
        for b in batches:
            if b.num_rows:
                k = np.array([number[x] for x in b.column("band").to_pylist()])
                a[k, b.column("row").to_numpy(), b.column("col").to_numpy()] = b.column("value").to_numpy(zero_copy_only=False)
        fs, root = (pafs.LocalFileSystem(), "/" + folder.split(":", 1)[-1].lstrip("/")) if folder.startswith("file:") or "://" not in folder else pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as f:
            f.write(encode(a, meta, tile))
        fs.move(temporary, f"{root}/raster.tif")
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    one = raster.df.select("band", "row", "col", F.col("value").cast("double").alias("value")).repartitionByRange(1, "band", "row", "col")
    one.mapInArrow(work, "done int").collect()
