"""Token-id files as directly addressable codes.

An id is split into chunks of `widths` bits, the lowest first. Level k holds the k-th chunks of all ids that have one, in order, and a
bitmap that tells which of them continue; a rank directory (ones before every 512th bit) finds an id's place in the next level, so any id
is read with a few array accesses and no block is decoded. A file holds a range of documents in ascending doc_id order:

    8 bytes b"GLDAC001", 8 bytes length of the header, header (JSON), sections at 8-byte borders as the header places them:
    doc_ids (int64), doc_null (uint8), starts (int64, one more than documents), per level chunks<k>, and but for the last bits<k> and ranks<k>
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import FILE, ROW, filesystem, materialize, publish, range_shards, scratch, with_address
from .tokens import Encoder, path_of

MAGIC = b"GLDAC001"
WIDTHS = (8, 8, 8, 8)
RANK_BLOCK = 512


def _kind(width: int) -> type:
    return np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> dict[str, np.ndarray]:
    """Sections of the levels of uint32 ids."""
    out, rest = {}, ids.astype(np.uint64)
    for k, w in enumerate(widths):
        out[f"chunks{k}"] = (rest & np.uint64((1 << w) - 1)).astype(_kind(w))
        rest = rest >> np.uint64(w)
        go = rest > 0
        if not go.any():
            return out
        assert k + 1 < len(widths), "an id is too large for the widths"
        bits = np.packbits(go, bitorder="little")
        out[f"bits{k}"] = bits
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (RANK_BLOCK // 8)))).reshape(-1, RANK_BLOCK // 8).sum(1)
        out[f"ranks{k}"] = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)
        rest = rest[go]
    return out


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    sections = {
        "doc_ids": np.array([0 if i is None else i for i in doc_ids], np.int64),
        "doc_null": np.array([i is None for i in doc_ids], np.uint8),
        "starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
    } | encode_levels(ids, widths)
    places, at, body = {}, 0, []
    for name, a in sections.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        places[name] = [at, len(a), a.dtype.str]
        at += len(raw)
        body.append(raw)
    header = json.dumps({"docs": len(doc_ids), "ids": len(ids), "widths": widths, "sections": places}, sort_keys=True).encode()
    header += b" " * (-len(header) % 8)
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *body])


class DacFile:
    """Access to any id, document or range of a file by its rank directories; only the bytes asked for are fetched.

    fetch(place, length) gives bytes of the file: of one in memory, or ranges of one in storage.
    """

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        start = fetch(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(start[8:], "little")
        head = json.loads(fetch(16, n))
        self.docs, self.ids, self.widths = head["docs"], head["ids"], head["widths"]
        self.sections = {k: (16 + n + place, count, np.dtype(kind)) for k, (place, count, kind) in head["sections"].items()}
        self.levels = sum(k.startswith("chunks") for k in self.sections)

    @staticmethod
    def of(raw: bytes) -> DacFile:
        return DacFile(lambda place, length: raw[place : place + length])

    def part(self, name: str, a: int, b: int) -> np.ndarray:
        """Elements a .. b (exclusive) of a section."""
        place, count, kind = self.sections[name]
        b = min(b, count)
        return np.frombuffer(self.fetch(place + a * kind.itemsize, (b - a) * kind.itemsize), kind) if a < b else np.empty(0, kind)

    def rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on to the next: one entry of the rank directory and less than a block of the bitmap."""
        block, byte = i // RANK_BLOCK, i >> 3
        bits = self.part(f"bits{level}", block * (RANK_BLOCK // 8), byte + 1)
        inside = byte - block * (RANK_BLOCK // 8)
        ones = int(np.bitwise_count(bits[:inside]).sum()) + (int(bits[inside] & ((1 << (i & 7)) - 1)).bit_count() if inside < len(bits) else 0)
        return int(self.part(f"ranks{level}", block, block + 1)[0]) + ones

    def __getitem__(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.ids:
            raise IndexError(i)
        value = shift = 0
        for k in range(self.levels):
            value |= int(self.part(f"chunks{k}", i, i + 1)[0]) << shift
            shift += self.widths[k]
            if k + 1 == self.levels or not self.part(f"bits{k}", i >> 3, (i >> 3) + 1)[0] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids a .. b (exclusive) of the file (uint32); of every level only their own stretch is read."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for k in range(self.levels):
            if a == b:
                break
            out[where] |= self.part(f"chunks{k}", a, b).astype(np.uint32) << np.uint32(shift)
            shift += self.widths[k]
            if k + 1 == self.levels:
                break
            bits = np.unpackbits(self.part(f"bits{k}", a >> 3, (b + 7) >> 3), bitorder="little")[a & 7 :][: b - a]
            where = where[np.flatnonzero(bits)]
            a = self.rank(k, a)
            b = a + len(where)
        return out

    def all(self) -> np.ndarray:
        return self.slice(0, self.ids)

    def documents(self, a: int, b: int) -> tuple[list[int | None], np.ndarray]:
        """doc_ids of the documents a .. b (exclusive) and where their ids start (one more)."""
        null = self.part("doc_null", a, b).tolist()
        return [None if n else i for i, n in zip(self.part("doc_ids", a, b).tolist(), null)], self.part("starts", a, b + 1)


def write_ids(docs: DataFrame, to: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = 64 << 20, least_shards: int = 24, file_ids: int = 8_000_000, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Writes the ids of all rows to files under `to` and returns the stored manifest: shard, part, file, docs, ids, bytes.

    Shards are doc_id ranges of about shard_bytes of text, the same for the same rows; within one, rows are sorted by doc_id (null first)
    and then by text, and files are closed at file_ids ids. A doc_id (or null) that fills more than two shards is dealt to several by the rows'
    places. Files appear under their final names only when whole; a repeated task writes the same bytes. What counts is the manifest: files that
    it doesn't list are no part of the table.
    """
    rows = with_address(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "text", F.xxhash64(FILE, ROW).alias("spread"))
    thin = materialize(rows.select("doc_id", "spread", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size")), "id-sizes")
    shard_of, n = range_shards(thin, "doc_id", F.col("size"), shard_bytes, least_shards, spread=F.col("spread"))
    sorted_rows = rows.withColumn("__gl_shard", shard_of).drop("spread").repartitionById(n, F.col("__gl_shard").cast("int")).sortWithinPartitions("__gl_shard", "doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        fs, root = filesystem(to)
        fs.create_dir(root, recursive=True)
        doc_ids: list = []
        chunks: list[bytes] = []
        held, shard, part = 0, None, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, chunks, held, part
            counts = np.array([len(c) // 4 for c in chunks], np.int64)
            raw = file_bytes(doc_ids, counts, np.frombuffer(b"".join(chunks), "<u4"), widths)
            name = f"ids-{shard:07d}-{part:05d}.dac"
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as f:
                f.write(raw)
            publish(fs, temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([len(doc_ids)], pa.int64()), "ids": pa.array([held], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})
            doc_ids, chunks, held, part = [], [], 0, part + 1
            return row

        for b in batches:
            for i, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("__gl_shard").to_pylist()):
                if shard is not None and (s != shard or held >= file_ids):
                    if doc_ids:
                        yield close()
                    part = 0 if s != shard else part
                shard = s
                ids = encoder.encode(t or "") + end
                doc_ids.append(i)
                chunks.append(ids)
                held += len(ids) // 4
        if doc_ids:
            yield close()

    return materialize(sorted_rows.mapInArrow(work, "shard int, part int, file string, docs long, ids long, bytes long"), "ids-manifest")


def read_ids(manifest: DataFrame, at: str, read_docs: int = 8_192, read_ids_at_once: int = 2_000_000) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it in the table), n_tokens, ids_crc32.

    Documents are found by the files' directories, and ids by rank, some read_ids_at_once at a time: no file is loaded as a whole.
    """
    base = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)))  # one row per file, not per document
    base = base.select("file", F.coalesce("base", F.lit(0).cast("long")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(at)
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    d = DacFile(lambda place, length: f.read_at(length, place))  # noqa: B023
                    for k in range(0, d.docs, read_docs):
                        doc_ids, starts = d.documents(k, min(k + read_docs, d.docs))
                        crc = _checksums(d, starts.tolist(), read_ids_at_once)
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    spread = base.select("file", "base", (F.row_number().over(Window.orderBy("file")) - 1).alias("i")).repartitionById(n, F.col("i").cast("int"))
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checksums(d: DacFile, starts: list[int], most: int) -> list[int]:
    """crc32 of each document's ids, read `most` at a time; long documents go over several reads."""
    out, at, raw = [], 0, memoryview(b"")
    for s, e in zip(starts, starts[1:]):
        crc = 0
        while s < e:
            if s >= at + len(raw) // 4 or s < at:
                at, stop = s, min(s + most, starts[-1])
                raw = memoryview(d.slice(at, stop).astype("<u4").tobytes())
            use = min(e, at + len(raw) // 4)
            crc = zlib.crc32(raw[4 * (s - at) : 4 * (use - at)], crc)
            s = use
        out.append(crc)
    return out


def op4_addressable_codes(spark, sf_dir: str) -> DataFrame:
    to = scratch(spark, "ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(write_ids(docs, to, path_of("word_bpe_49k.json"), end_id=2), to)
