"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards (the same ranges for the same rows), every shard is written by one task as files that roll
at a compressed size, and headers and digests are made anew from the payload. A record is a gzip member of its own. Equal
payloads of some size are stored once: all but the record with the largest page id are revisits. Files are written under temporary names
and renamed when whole; a manifest, stored by Spark's own commit, lists the files that count. A repeated task writes the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import FILE, ROW, attach, filesystem, materialize, publish, range_shards, scratch, stored, with_address
from .op5_exact import digest_key

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6a1f2b54-93f1-5d0c-9a57-0f3c1d7be1d2")


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{url}|{digest}')}>"


def header_safe(value: str) -> str:
    """A header value on one line: control characters and blanks are percent-encoded."""
    return value if value.isascii() and value.isprintable() and " " not in value else quote(value, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record: a response, or with refers_to a revisit of it, whose block has the HTTP headers alone."""
    digest = sha1_label(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_safe(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {sha1_label(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {header_safe(refers_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield head, block


def write_warc(pages: DataFrame, to: str, least_revisit: int = 1000, roll_bytes: int = 256 << 20, shard_bytes: int = 256 << 20, least_shards: int = 24, date: str = "2024-01-01T00:00:00Z", level: int = 6, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one record per row of pages under `to`; returns the stored manifest: shard, part, file, records, bytes.

    Payloads are html in UTF-8 (null: empty). Of equal payloads of at least least_revisit bytes the record with the largest page id is
    the response; repeated rows with that id are all responses. Rows with a null page id are responses, sort first and are referred to by none.
    Rows with equal ids are in the order of a hash of url and html; where one id (or null) fills more than two shards, that hash deals its
    rows to shards. Other columns are not read.
    """
    pages = stored(pages)
    rows = with_address(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")))
    size = F.octet_length("html").cast("long")
    thin = rows.select("page_id", "url", FILE, ROW, F.xxhash64("url", "html").alias("tie"), size.alias("size"), F.when(size >= least_revisit, digest_key(F.col("html"))).alias("key"))
    thin = materialize(thin, "payload-digests")
    groups = thin.filter(F.col("key").isNotNull() & F.col("page_id").isNotNull()).groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("answer"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1"), "payload-groups")
    found = attach(thin.filter(F.col("key").isNotNull() & F.col("page_id").isNotNull()), groups, "key", "n", unique=F.xxhash64(FILE, ROW)).filter(F.col("answer.page_id") > F.col("page_id"))
    # directives travel as rows that sort right before their page: the pages are shuffled once
    null = lambda kind: F.lit(None).cast(kind)
    orders = found.select("page_id", null("string").alias("url"), null("binary").alias("html"), "tie", FILE, ROW, F.lit(0).alias("kind"), F.col("answer.page_id").alias("refers_to"), F.col("answer.url").alias("refers_url"))
    full = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.xxhash64("url", "html").alias("tie"), FILE, ROW, F.lit(1).alias("kind"), null("long").alias("refers_to"), null("string").alias("refers_url"))
    shard_of, n = range_shards(thin, "page_id", F.col("size") + 400, shard_bytes, least_shards, spread=F.col("tie"))
    both = orders.unionByName(full).withColumn("__gl_shard", shard_of)
    placed = both.repartitionById(n, F.col("__gl_shard").cast("int")).sortWithinPartitions("__gl_shard", "page_id", "tie", FILE, ROW, "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(to)
        fs.create_dir(root, recursive=True)
        out = name = temporary = None
        shard, part, written, count = None, 0, 0, 0
        order: tuple | None = None

        def close() -> pa.RecordBatch:
            nonlocal out, part
            out.close()
            publish(fs, temporary, f"{root}/{name}")
            out, part = None, part + 1
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part - 1], pa.int32()), "file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for b in batches:
            for s, i, u, h, f, r, kind, to_id, to_url in zip(*(b.column(c).to_pylist() for c in ("__gl_shard", "page_id", "url", "html", FILE, ROW, "kind", "refers_to", "refers_url"))):
                if kind == 0:
                    order = (f, r, to_id, to_url)
                    continue
                if out is not None and (s != shard or written >= roll_bytes):
                    yield close()
                if s != shard:
                    shard, part = s, 0
                if out is None:
                    name = f"pages-{shard:06d}-{part:05d}.warc.gz"
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                    out, count = fs.open_output_stream(temporary, compression=None), 0
                    first = member(info_record(name, date), level)
                    out.write(first)
                    written = len(first)
                told = order[2:] if order and order[:2] == (f, r) else (None, None)
                order = None
                data = member(record(i, u, h or b"", date, *told), level)
                out.write(data)
                written += len(data)
                count += 1
        if out is not None:
            yield close()

    return materialize(placed.mapInArrow(work, "shard int, part int, file string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, at: str) -> DataFrame:
    """One row per page record of the manifest's files: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url, file.

    Block digests are checked, and payload digests of responses; a wrong one is an error.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(at)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for head, block in records(stream):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"]
                        if sha1_label(block) != head["warc-block-digest"] or head["warc-type"] == "response" and sha1_label(payload) != digest:
                            raise ValueError(f"{name}: a digest is wrong")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        whole = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((whole("warc-page-id"), size, base64.b32decode(digest[5:]).hex(), head["warc-type"], whole("warc-refers-to-page-id"), head.get("warc-target-uri"), name))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    n = max(1, manifest.count())
    files = manifest.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("i")).repartitionById(n, F.col("i").cast("int"))  # one row per file
    return files.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"])


def op2_sharded_warc(spark, sf_dir: str) -> DataFrame:
    to = scratch(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), to), to).drop("url", "file")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, url, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""
