"""Members of zip, tar and gz archives as rows, read by one task per archive."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and content of each file in an archive; a plain gz has one, without a name."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for n in z.namelist():
                if not n.endswith("/"):
                    yield n, z.read(n)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
            return
    except tarfile.ReadError:
        pass
    yield "", gzip.decompress(raw)


def read(spark: SparkSession, path: str, member: int | None = None) -> DataFrame:
    """archive, i, name, content of all members, or of the member-th of each archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for i, (name, content) in enumerate(members(raw)):
                    if member is None or i == member:
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([i], pa.int32()), pa.array([name]), pa.array([content], pa.binary())], names=["archive", "i", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "archive string, i int, name string, content binary")
