"""Catalogue items: bounding boxes, assets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def intersects(bbox: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed overlap; items without a box pass."""
    return bbox.isNull() | ((bbox[0] <= box[2]) & (bbox[2] >= box[0]) & (bbox[1] <= box[3]) & (bbox[3] >= box[1]))


def href(assets: Column, key: str) -> Column:
    """The asset's address; a missing asset is an error."""
    got = assets[key]["href"]
    return F.coalesce(got, F.raise_error(F.lit(f"an item has no asset {key}")).cast("string"))


def select_items(items: DataFrame, asset: str, box: tuple[float, float, float, float] | None = None, most: int | None = None, patch: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, href of the items that meet the box, at most `most` of them by id."""
    hit = items if box is None else items.filter(intersects(F.col("bbox"), box))
    if most is not None:
        hit = hit.orderBy("id").limit(most)
    h = href(F.col("assets"), asset)
    return hit.select("id", (patch(h) if patch else h).alias("href"))
