"""The shop example: brands, products and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_brand(products: DataFrame, brands: DataFrame, day: str | None = None) -> DataFrame:
    """Products with the name of their brand, optionally of one ``date_id``."""
    rows = products if day is None else products.where(F.col("date_id") == day)
    return rows.join(brands.select(F.col("id").alias("brand_id"), "brand_name"), "brand_id").select(
        "occurred_at", F.col("id").alias("product_id"), "brand_name"
    )


def clicks_of_shop(clicks: DataFrame, shop_code: str) -> DataFrame:
    return clicks.where(F.col("shop_code") == shop_code).select("id", "url")


def clicks_group_min(clicks: DataFrame) -> DataFrame:
    """The smallest click id per url and shop; columns are taken by position."""
    return clicks.groupBy("url", "shop_code").agg(F.min("id").alias("min_id"))
