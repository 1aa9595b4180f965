"""Audits of catalogs: coverage against what is stored, duplicates, completeness, pagination, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import clean_text, fold
from .quality import placeholder_image


def _urls(df: DataFrame, column: str) -> DataFrame:
    return df.select(urls.canonical_url(F.col(column)).alias("url")).where("url is not null").distinct()


def compare(web: DataFrame, base: DataFrame, column: str = "source_url") -> DataFrame:
    """(url, on_web, in_base): one row per canonical address of either side."""
    a, b = _urls(web, column).withColumn("on_web", F.lit(True)), _urls(base, column).withColumn("in_base", F.lit(True))
    return a.join(b, "url", "full_outer").select("url", F.coalesce("on_web", F.lit(False)).alias("on_web"), F.coalesce("in_base", F.lit(False)).alias("in_base"))


def coverage(compared: DataFrame) -> DataFrame:
    """(web, base, found, missing, stale, coverage_percent); without web addresses 100 if there are none stored, else 0."""
    row = compared.agg(
        F.count_if("on_web").alias("web"), F.count_if("in_base").alias("base"), F.count_if(F.col("on_web") & F.col("in_base")).alias("found"),
        F.count_if(F.col("on_web") & ~F.col("in_base")).alias("missing"), F.count_if(~F.col("on_web") & F.col("in_base")).alias("stale"),
    )
    share = F.when(F.col("web") == 0, F.when(F.col("base") == 0, 100.0).otherwise(0.0)).otherwise(F.round(F.col("found") * 100.0 / F.col("web"), 2))
    return row.withColumn("coverage_percent", share.cast("double"))


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of the keys that more than one row has."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("key").isNotNull() & (F.col("key") != "") & (F.col("n") > 1))


def duplicate_urls(products: DataFrame) -> DataFrame:
    return duplicate_counts(products, urls.canonical_url(F.col("source_url")))


def duplicate_skus(products: DataFrame) -> DataFrame:
    return duplicate_counts(products, F.lower(F.trim("sku")))


def possible_duplicates(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): (key, n, n_urls) of one name, brand and image under several records, and (key, url, n) of their addresses.

    A default image may put very many records into one group, so that its addresses are rows, not a list.
    """
    name, image = F.nullif(fold(F.col("product_name")), F.lit("")), urls.canonical_url(F.col("image_url"))
    brand = F.coalesce(F.nullif(fold(F.col("brand")), F.lit("")), F.lit("no-brand"))
    keyed = products.where(name.isNotNull() & image.isNotNull()).select(F.concat_ws("|", name, brand, image).alias("key"), urls.canonical_url(F.col("source_url")).alias("url"))
    by_url = keyed.groupBy("key", "url").agg(F.count("*").alias("n"))
    groups = by_url.groupBy("key").agg(F.sum("n").alias("n"), F.count("url").alias("n_urls")).where("n > 1")
    return groups, by_url.where("url is not null").join(groups.select("key"), "key", "left_semi")


def completeness(products: DataFrame) -> DataFrame:
    """Records in all, with price, with code, and with a real, a missing and a rejected image."""
    image = F.trim(F.coalesce("image_url", F.get("image_urls", F.lit(0))))
    none = F.coalesce(image, F.lit("")) == ""
    return products.agg(
        F.count("*").alias("records"), F.count_if(clean_text(F.col("price")).isNotNull()).alias("with_price"), F.count_if(clean_text(F.col("sku")).isNotNull()).alias("with_sku"),
        F.count_if(~none & ~placeholder_image(image)).alias("image_real"), F.count_if(none).alias("image_missing"), F.count_if(~none & placeholder_image(image)).alias("image_rejected"),
    )


def pagination(pages: DataFrame) -> DataFrame:
    """Per listing of ``pages`` (listing_url, url, page, product_count, new_in_listing): last page, whether it was visited, and repeated pairs of pages.

    A pair repeats if page n + 1 has as many products as page n and none that is new.
    """
    listing = F.coalesce("listing_url", "url")
    order = Window.partitionBy("listing").orderBy(F.coalesce("page", F.lit(1)), "url")
    rows = pages.withColumn("listing", listing)
    nxt = rows.select("listing", "page", "product_count", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("page", "product_count", "new_in_listing")))
    repeated = (F.col("page") + 1 == F.col("next_page")) & F.col("product_count").eqNullSafe(F.col("next_product_count")) & (F.col("next_new_in_listing") == 0)
    last = F.greatest(F.lit(1), F.max("page"))
    return nxt.groupBy("listing").agg(last.alias("last_page"), F.coalesce(F.max("page") >= 1, F.lit(False)).alias("visited_last_page"), F.count_if(F.coalesce(repeated, F.lit(False))).alias("repeated_pairs"))


def status(coverage_percent: Column, pagination_failures: Column, http_errors: Column, rejected: Column, without_price: Column, without_sku: Column, without_image: Column) -> Column:
    """CRITICAL, REVIEW or OK."""
    critical = (coverage_percent < 70) | (pagination_failures > 0) | (http_errors > 0) | (rejected > 0)
    review = (coverage_percent < 95) | (without_price > 0) | (without_sku > 0) | (without_image > 0)
    return F.when(critical, "CRITICAL").when(review, "REVIEW").otherwise("OK")


def pipeline_counts(discovered: DataFrame, extracted: DataFrame, valid: DataFrame, limited: bool, duplicates: int = 0, rejected: int = 0, errors: int = 0) -> DataFrame:
    """One row of counts; ``estimated_coverage`` is valid by unique addresses, null if discovery was limited."""
    found = discovered.agg(F.count("url").alias("urls_discovered"), F.count_distinct("url").alias("urls_unique"))
    good = valid.agg(
        F.count("*").alias("products_valid"), F.count_if(clean_text(F.col("price")).isNotNull()).alias("prices"), F.count_if(clean_text(F.col("sku")).isNotNull()).alias("sku"),
        F.count_if(F.col("image_url").isNotNull() | (F.coalesce(F.size("image_urls"), F.lit(0)) > 0)).alias("images"),
    )
    one = found.join(extracted.agg(F.count("*").alias("products_extracted")), F.lit(True)).join(good, F.lit(True))
    share = F.when(F.lit(limited), None).when(F.col("urls_unique") > 0, F.col("products_valid") / F.col("urls_unique")).otherwise(0.0)
    return one.withColumns({"duplicates": F.col("urls_discovered") - F.col("urls_unique") + F.lit(duplicates), "rejected": F.lit(rejected), "errors": F.lit(errors), "limited": F.lit(limited), "estimated_coverage": share})


def by_severity(audits: DataFrame) -> DataFrame:
    """Worst first: by status, then low coverage, then many errors."""
    rank = F.when(F.col("status") == "CRITICAL", 0).when(F.col("status") == "REVIEW", 1).otherwise(2)
    return audits.orderBy(rank, "coverage_percent", F.desc("errors"), "site")


def report_rows(row: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value): a one-row report as lines for a CSV file."""
    return row.select(*(F.col(c).cast("string").alias(c) for c in names)).unpivot([], names, "metric", "value")


def category_gaps(pages: DataFrame) -> DataFrame:
    """Per category: declared, extracted, new and repeated products, largest gap first."""
    sums = pages.groupBy("category").agg(F.max("declared").alias("declared"), *(F.sum(c).alias(c) for c in ("extracted", "new", "repeated")))
    return sums.withColumn("gap", F.col("declared") - F.col("extracted")).orderBy(F.desc("gap"), "category")


def fields_available(products: DataFrame, names: list[str]) -> DataFrame:
    """One row of booleans: whether any record has the field."""
    return products.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in names))
