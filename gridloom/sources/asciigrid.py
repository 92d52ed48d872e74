"""ESRI ASCII grids: text, a header of six lines, then one line of values per row, north first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..meta import RasterMeta
from ..operators.raster import Raster


def header_of(text: str) -> dict[str, float]:
    """The header's entries in lower case."""
    out = {}
    for line in text.splitlines():
        parts = line.split()
        if len(parts) != 2 or not parts[0][0].isalpha():
            break
        out[parts[0].lower()] = float(parts[1])
    return out


def meta_of(head: dict[str, float], epsg: int = 4326) -> RasterMeta:
    rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    y = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    return RasterMeta(rows, cols, x0, y + rows * size, size, size, epsg, head.get("nodata_value", -9999.0))


def read(spark: SparkSession, path: str, epsg: int = 4326) -> Raster:
    """One grid; only its header comes to the driver. Lines keep their order by their number in the file."""
    lines = spark.read.text(path, wholetext=True)
    top = lines.select(F.substring("value", 1, 4096)).first()[0]
    head = header_of(top)
    meta = meta_of(head, epsg)
    body = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).filter(F.col("line") >= len(head))
    words = body.select((F.col("line") - len(head)).alias("row"), F.split(F.trim("text"), r"\s+").alias("w")).filter(F.col("row") < meta.rows)
    cells = words.select(F.lit(1).alias("band"), "row", F.posexplode("w").alias("col", "s")).select("band", "row", "col", F.col("s").cast("double").alias("value"))
    return Raster(cells, meta).from_sentinel(meta.nodata)


def body_lines(raster: Raster, fmt: str = "%s", band: int = 0) -> DataFrame:
    """row and the line of its values; no data as the sentinel."""
    text = F.coalesce(F.format_string(fmt, F.col("value")) if fmt != "%s" else F.col("value").cast("string"), F.lit(f"{raster.meta.nodata:g}"))
    text = F.when(F.col("value").isNull(), F.lit(f"{raster.meta.nodata:g}")).otherwise(text)
    cells = raster.band(band).df.select("row", F.struct("col", text.alias("s")).alias("p"))
    return cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), " ").alias("line"))


def write(raster: Raster, path: str, band: int = 0) -> None:
    """Header and lines as one text file under path; fails if path exists."""
    m = raster.meta
    if m.dx != m.dy:
        raise ValueError("an ASCII grid has square cells")
    head = [f"ncols {m.cols}", f"nrows {m.rows}", f"xllcorner {m.bbox[0]!r}", f"yllcorner {m.bbox[1]!r}", f"cellsize {m.dx!r}", f"NODATA_value {m.nodata!r}"]
    spark = raster.df.sparkSession
    top = spark.createDataFrame([(i - len(head), t) for i, t in enumerate(head)], "row int, line string")
    lines = top.unionByName(body_lines(raster, band=band))
    lines.repartitionByRange(1, "row").sortWithinPartitions("row").select("line").write.mode("error").text(path)
