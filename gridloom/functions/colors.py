"""Colours: hex text to channels, names and codes of colour interpretations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Colour interpretations of bands and their usual codes.
CODES = {"undefined": 0, "gray_index": 1, "palette_index": 2, "red": 3, "green": 4, "blue": 5, "alpha": 6, "hue": 7, "saturation": 8, "lightness": 9, "cyan": 10, "magenta": 11, "yellow": 12, "black": 13, "YCbCr_YBand": 14, "YCbCr_CbBand": 15, "YCbCr_CrBand": 16}


def channel(color: Column, i: int) -> Column:
    """The i-th channel (from 0) of #rrggbb or #rrggbbaa; a missing alpha is 255."""
    part = F.substring(color, 2 + 2 * i, 2)
    return F.when(F.length(part) == 2, F.conv(part, 16, 10).cast("int")).otherwise(F.lit(255))


def color_table(palette: DataFrame) -> DataFrame:
    """palette (values, color) as values, red, green, blue, alpha."""
    return palette.select("values", *(channel(F.col("color"), i).alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))))


def code_of(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[name]


def name_of(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in CODES.items() for x in (v, k)))[code]
