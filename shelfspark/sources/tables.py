"""Reading and writing the engine's tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..schema import PRODUCT, conform


def read_products(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Product records from Parquet, or from JSON lines with the fixed schema (nothing is inferred)."""
    reader = spark.read if kind == "parquet" else spark.read.schema(PRODUCT)
    return conform(getattr(reader, kind)(path))


def archive(products: DataFrame, path: str, site: str = "site") -> None:
    """JSON lines in one folder per site."""
    products.withColumn("site_key", urls.site_key(F.col(site))).write.partitionBy("site_key").mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """(metric, value) as CSV, quotes doubled; reports are a few lines."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """A table's next version beside the older ones; readers switch by the version they are given."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out
