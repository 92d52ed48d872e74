"""The folder that all executors share, tables stored in it, and ranks over stored tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder, but only if the executors live in this very process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir()


def store(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the rank of each row by key, from 0: ranges are sorted in parallel, and only the partitions' sizes are added up."""
    rows = store(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row per partition
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).cast("int")).select(*df.columns, name)
