"""Exact dedup by a tree merge of sorted digest runs; DataFrame functions only.

The digests of one input partition are a run. In every round `fan_in` neighbouring runs become one: each sends its rows to the tasks of the
new run, which sort what they got and merge it in one pass, so that of equal digests one row goes on, with the best identifier so far and
the number of rows that it stands for. Rounds grow with the logarithm of the runs. As runs get fewer they are cut into more slices
by digest range: round k has (runs left) x (slices) tasks of about task_rows rows, and the last run is one sorted table over all slices. A copied text
leaves at most one row per run after its first round, so no task ever sees all copies of a hot text. Rows meet on the first bytes of their SHA-256 and are
merged only if all of it, the length and a second 64-bit hash agree; verify_texts compares the texts of the merged rows as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import FILE, ROW, ascii_lower, attach, materialize, plain_names, stored, with_address

KEY, RUN, PLACE = "__gl_key48", "__gl_run", "__gl_place"


def digest_key(text: Column) -> Column:
    """SHA-256, length and xxhash64 of a normalised text as 48 bytes."""
    return F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def merge_rounds(runs: int, tasks: int, fan_in: int) -> list[tuple[int, int]]:
    """(runs, slices) after each round, down to one run; runs times slices is never below tasks."""
    out = []
    while not out or runs > 1:
        runs = -(-runs // fan_in)
        out.append((runs, -(-tasks // runs)))
    return out


def tree_merge(rows: DataFrame, best: Column, keep: str = "max", fan_in: int = 16, task_rows: int = 1_000_000) -> DataFrame:
    """rows: stored, with KEY and RUN (number of the run). One row per key: best, group_size."""
    pick = F.max if keep == "max" else F.min
    n, last = rows.agg(F.count(F.lit(1)), F.max(RUN)).first()
    tasks = max(1, -(-n // task_rows), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 50_000)))
    merged = rows.select(KEY, RUN, best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    high = F.conv(F.hex(F.substring(KEY, 1, 4)), 16, 10).cast("long")
    for runs, slices in merge_rounds((last or 0) + 1, tasks, fan_in):
        place = F.shiftright(high * slices, 32) * runs + F.expr(f"{RUN} div {fan_in}")
        merged = merged.withColumn(PLACE, place.cast("int")).repartitionById(runs * slices, F.col(PLACE)).sortWithinPartitions(PLACE, KEY)
        merged = merged.groupBy(PLACE, KEY).agg(pick("best").alias("best"), F.sum("group_size").alias("group_size")).withColumn(RUN, F.col(PLACE) % runs)
    return merged.select(KEY, "best", "group_size")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", fan_in: int = 16, task_rows: int = 1_000_000, verify_texts: bool = False, digest: Callable[[Column], Column] = digest_key) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the row's address (__gl_file, __gl_row).

    Equal means identical after lower-casing A-Z; a null text is an empty one. Of equal texts the row with the largest (keep="min": the
    smallest) doc_id stays; null ids lose to any other. Of repeated rows with that doc_id exactly one is kept, by its place in the
    files. If a group has null ids only, keep_id is null and one row is kept. Other columns of docs are not read, whatever their names.
    An empty table gives an empty result. verify_texts also compares texts (a shuffle of them, the least and the greatest per digest and task):
    rows whose digest has two texts are then merged anew by the texts themselves. digest gives binary keys, of at least 4 bytes.
    """
    source = with_address(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    rows = materialize(source.select("doc_id", FILE, ROW, F.spark_partition_id().alias(RUN), digest(norm).alias(KEY), F.sha2(norm, 256).alias("sha") if digest is not digest_key else F.lit(None).cast("string").alias("sha")), "digests")
    null = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    best = F.struct(null.alias("n"), F.col("doc_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    if verify_texts:
        texts = source.select(FILE, ROW, norm.alias("t"), digest(norm).alias(KEY))
        mixed = materialize(texts.groupBy(KEY).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select(KEY), "mixed-digests")
        if mixed.limit(1).count():
            told = texts.join(mixed, KEY).select(FILE, ROW, F.concat(F.col(KEY), F.encode("t", "UTF-8")).alias("by_text"))
            rows = materialize(rows.join(told, [FILE, ROW], "left").withColumn(KEY, F.coalesce("by_text", KEY)).drop("by_text"), "told-apart")
    groups = materialize(tree_merge(rows, best, keep, fan_in, task_rows), "winners")
    out = attach(rows, groups, KEY, "group_size", unique=F.xxhash64(FILE, ROW))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("best.file") == F.col(FILE)) & (F.col("best.row") == F.col(ROW)))).alias("kept"),
        F.coalesce("sha", F.lower(F.hex(F.substring(KEY, 1, 32)))).alias("text_sha256"),
        FILE,
        ROW,
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups."""
    docs = stored(docs)
    gone = exact_groups(docs, text, doc_id, keep).filter(~F.col("kept")).select(FILE, ROW)
    plain = plain_names(docs)
    return with_address(plain).join(gone, [FILE, ROW], "left_anti").select(*plain.columns).toDF(*docs.columns)


def op5_tree_merge_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(FILE, ROW)


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
