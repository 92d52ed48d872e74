"""Paths: schemes, archives, ordering of files, chunk sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def is_remote(path: Column) -> Column:
    return path.rlike(r"^(?i)(s3a?|gs|az|abfss?|https?|hdfs|wasbs?)://")


def target(path: Column) -> Column:
    """The path under the scheme that Spark's file systems know."""
    return F.regexp_replace(F.regexp_replace(path, r"^s3://", "s3a://"), r"^(az|abfs)://", "abfss://")


def archive(path: Column) -> Column:
    """zip, tar or gz by the file's extension, else null."""
    p = F.lower(path)
    return F.when(p.endswith(".zip"), "zip").when(p.rlike(r"\.(tar|tgz|tar\.gz)$"), "tar").when(p.endswith(".gz"), "gz")


def ordered(files: DataFrame) -> DataFrame:
    """path, t in lexicographic order; one row per file."""
    return files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("t"))


def ordered_by_date(files: DataFrame, pattern: str, fmt: str, start: str | None = None, end: str | None = None, extension: str | None = None) -> DataFrame:
    """t, path, stamp of the files whose name holds a date within start .. end (inclusive), in its order."""
    f = files if extension is None else files.filter(F.col("path").endswith(extension))
    f = f.withColumn("stamp", F.to_date(F.nullif(F.regexp_extract("path", f"({pattern})", 1), F.lit("")), fmt)).filter(F.col("stamp").isNotNull())
    if start is not None:
        f = f.filter(F.col("stamp") >= F.lit(start).cast("date"))
    if end is not None:
        f = f.filter(F.col("stamp") <= F.lit(end).cast("date"))
    return f.select((F.row_number().over(Window.orderBy("stamp", "path")) - 1).cast("int").alias("t"), "path", "stamp")


def chunks(spec: Column, rows: int, cols: int, block: int) -> tuple[Column, Column]:
    """rows and cols of a tile from 'auto', one size or 'rows,cols' (-1: all)."""
    parts = F.split(spec, ",")
    def size(i: int, whole: int) -> Column:
        n = F.coalesce(F.get(parts, F.lit(i)), parts[0]).try_cast("int")
        return F.when(spec == "auto", F.lit(block)).when(n == -1, F.lit(whole)).otherwise(n)

    return size(0, rows).alias("rows"), size(1, cols).alias("cols")
