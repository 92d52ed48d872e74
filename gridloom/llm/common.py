"""Helpers shared by the training-data operators: shared storage, row addresses, skew-safe joins, range shards."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FILE, ROW = "__gl_file", "__gl_row"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dir: str | None = None
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's program ends, if its session still runs then."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  # the session has ended, or the store is gone: nothing more can be done at exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, uri: str) -> None:
    """Deletes a scratch path that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for use on executors; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Renames a finished file to its final name. Another attempt of the same task wrote the same bytes, so either may win."""
    if isinstance(fs, pafs.LocalFileSystem):
        fs.move(temporary, final)  # replaces
        return
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)


PLAIN_NODES = ("Project", "Filter", "Relation", "SubqueryAlias", "View")


def plain_read(df: DataFrame) -> bool:
    """Whether df is columns and filters over a Parquet read: then its rows have addresses, and every evaluation gives the same ones."""
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = [line.lstrip(" :+-|") for line in plan.splitlines() if line.strip()]
    return all(n.startswith(PLAIN_NODES) for n in nodes) and sum(n.startswith("Relation") and n.endswith("parquet") for n in nodes) == 1


def stored(df: DataFrame) -> DataFrame:
    """df itself if it is a plain read, else a stored copy."""
    return df if plain_read(df) else materialize(df, "stored")


def with_address(df: DataFrame) -> DataFrame:
    """Adds __gl_file and __gl_row, which tell every row from every other, equal rows too, and stay the same on each read.

    They come from Parquet's row index; a DataFrame that isn't a plain Parquet read is written to the shared folder first.
    """
    return stored(df).select("*", F.xxhash64(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias(ROW))


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns as c0, c1, ...: no name of theirs is then one that an operator adds. toDF(*names) gives them back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Where a text has ASCII alone, lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 50_000, most_hot: int = 50_000, unique: Column | None = None) -> DataFrame:
    """rows left-joined with groups (a stored table: one row per key, with the number of its rows in size) with no hot task.

    Groups of one row are not joined: their columns are null in the result, and callers know what they would be. Groups of at least
    max(hot, rows / most_hot) rows are at most most_hot in number whatever the input, and are broadcast; the others are joined by
    shuffle, and rows that have found their group get a key of their own there (unique), so no key holds more rows than that.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(hot, total // most_hot + 1)
    cols = [c for c in groups.columns if c != key]
    if total < limit:  # no group can be hot
        return rows.join(groups.filter(F.col(size) > 1), key, "left")
    big = groups.filter(F.col(size) >= limit).select(key, *(F.col(c).alias(f"__gl_h_{c}") for c in cols))
    cold = groups.filter((F.col(size) > 1) & (F.col(size) < limit)).select(F.col(key).alias("__gl_key"), *cols)
    found = F.col(f"__gl_h_{size}").isNotNull()
    own = unique if unique is not None else F.monotonically_increasing_id()
    kind = dict(rows.dtypes)[key]
    a = rows.join(F.broadcast(big), key, "left")
    if kind == "binary":
        a = a.withColumn("__gl_key", F.when(found, F.encode(own.cast("string"), "UTF-8")).otherwise(F.col(key)))
        a = a.join(cold, "__gl_key", "left")
    else:  # a key beside the real one that differs for rows already matched
        a = a.withColumn("__gl_key", F.col(key)).withColumn("__gl_salt", F.when(found, own.cast("long")).otherwise(F.lit(0).cast("long")))
        a = a.join(cold.withColumn("__gl_salt", F.lit(0).cast("long")), ["__gl_key", "__gl_salt"], "left").drop("__gl_salt")
        return a.select(*rows.columns, *(F.when(F.col(f"__gl_h_{size}").isNotNull(), F.col(f"__gl_h_{c}")).otherwise(F.col(c)).alias(c) for c in cols))
    return a.select(*rows.columns, *(F.coalesce(f"__gl_h_{c}", c).alias(c) for c in cols))


def range_shards(df: DataFrame, key: str, weight: Column, target: int, least: int = 1, bins: int = 2048, rounds: int = 4, spread: Column | None = None) -> tuple[Column, int]:
    """Shard numbers (a column over key) and how many: ascending key ranges of about `target` weight each (null comes first), the same for the same rows.

    Range cuts come from exact histograms over the key (`bins` bins, four a shard at least), refined where a bin is heavy; the driver sees only bins.
    Integer keys only. A single key (or null) heavier than two shards is dealt to shards of its own by the hash `spread`; without that it is never cut.
    """
    spans = df.agg(F.min(key), F.max(key), F.sum(weight), F.sum(F.when(F.col(key).isNull(), weight))).first()
    lo, hi, total, nulls = spans[0], spans[1], int(spans[2] or 0), int(spans[3] or 0)
    target = max(1, min(target, total // least + 1), total // 50_000)  # at most some 50,000 shards
    parts = lambda w: -(-w // target) if spread is not None and w > 2 * target else 1
    null_parts = parts(nulls)
    first = null_parts if null_parts > 1 else 0  # a light null goes into the first shard of keys
    bins = max(bins, 4 * (total // target + 1))
    cells: list[tuple[int, int, int]] = [] if lo is None else [(lo, hi, total - nulls)]  # first key, last key, weight
    for _ in range(rounds):
        heavy = sorted((c for c in cells if 4 * c[2] > target and c[0] < c[1]), key=lambda c: (-c[2], c[0]))[: bins // 2]
        if not heavy:
            break
        per = bins // len(heavy)
        edges = sorted({a + (b - a + 1) * i // per for a, b, _ in heavy for i in range(per)} | {b + 1 for _, b, _ in heavy})
        slot = _slot(F.col(key), None, edges, list(range(len(edges) + 1)), [1] * (len(edges) + 1), 0, 1)
        sums = {r[0]: int(r[1] or 0) for r in df.filter(F.col(key).isNotNull()).groupBy(slot.alias("s")).agg(F.sum(weight)).collect()}
        inside = lambda x: any(a <= x <= b for a, b, _ in heavy)  # noqa: B023, E731
        split = [(a, b - 1, sums[i + 1]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if sums.get(i + 1) and inside(a)]
        cells = [c for c in cells if c not in heavy] + split
    cuts, counts, run = [], [1], 0
    for a, b, w in sorted(cells):
        k = parts(w) if a == b else 1
        if run and (run + w > target or k > 1):
            cuts.append(a)
            counts.append(1)
            run = 0
        counts[-1] = k
        run += w
    firsts = [first]
    for k in counts[:-1]:
        firsts.append(firsts[-1] + k)
    return _slot(F.col(key), spread, cuts, firsts, counts, 0, null_parts), firsts[-1] + counts[-1]


def _slot(key: Column, spread: Column | None, edges: list[int], firsts: list[int], counts: list[int], null_first: int, null_count: int) -> Column:
    """Of the ascending edges those at most key are counted: firsts[that], and a part by spread of counts[that]. A balanced tree of comparisons."""
    def place(i: int, n: int) -> Column:
        return F.lit(i) if n == 1 else F.lit(i) + F.pmod(spread, F.lit(n).cast("long")).cast("int")

    def tree(i: int, j: int) -> Column:
        if i == j:
            return place(firsts[i], counts[i])
        m = (i + j) // 2
        return F.when(key >= F.lit(edges[m]), tree(m + 1, j)).otherwise(tree(i, m))

    if len(edges) <= 64:
        return F.when(key.isNull(), place(null_first, null_count)).otherwise(tree(0, len(edges)))
    find = F.pandas_udf(lambda s, h: _search(s, h, edges, firsts, counts, null_first, null_count), "int")
    return find(key, F.lit(0).cast("long") if spread is None else spread)


def _search(s, h, edges, firsts, counts, null_first, null_count):
    import pandas as pd

    none, h = s.isna().to_numpy(), h.to_numpy()
    at = np.searchsorted(np.array(edges), s.fillna(edges[0] - 1).astype("int64"), side="right")
    first, count = np.array(firsts)[at], np.array(counts)[at]
    return pd.Series(np.where(none, null_first + h % null_count, first + h % count).astype("int32"))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table, over batch borders. Keys mustn't be null."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.table(batch)
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cut = np.flatnonzero(change).tolist()
        starts, ends = [0, *cut], [*cut, t.num_rows]
        for i, (s, e) in enumerate(zip(starts, ends)):
            if i or (last is not None and first != last):
                if held:
                    yield pa.concat_tables(held)
                held = []
            held.append(t.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


class WordIds(dict):
    """Small integers for words, given as they come; for use inside one document or one batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def per_document(texts: Iterator[pa.RecordBatch], column: str, work: Callable[[bytes], tuple]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with work(text in UTF-8, b'' for null) of its rows."""
    for batch in texts:
        yield batch, [work(x or b"") for x in batch.column(column).to_pylist()]
