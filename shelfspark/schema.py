"""The product record: one row per observation of a product on a page, all fields optional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = ("product_name", "price", "currency", "brand", "sku", "category", "description", "availability", "stock", "source_url", "image_url", "image_path")
LISTS = ("image_urls", "compatible_vehicles", "compatible_models", "compatible_versions", "compatible_brands", "shipping_info")
PRODUCT = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} array<string>" for c in LISTS), "attributes map<string,string>", "quality_warnings array<string>", "extracted_at timestamp", "provider string"])
#: Place in the order of arrival; every merge needs it, as later values win and first places stay.
ORDER = "_ord"


def conform(df: DataFrame) -> DataFrame:
    """``df`` with every product column, missing ones as nulls; other columns stay."""
    types = dict(x.split(" ", 1) for x in PRODUCT.split(", "))
    have = set(df.columns)
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in have))
