"""A catalog run over stored pages: discover, extract, normalise, validate, audit, and the next inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import audit, crawl, dedupe, inventory, quality, walks
from ..operators.rules import SiteRule
from ..schema import ORDER, conform
from ..shared import write_table
from ..sources import profiles

MODES = ("discover", "probe", "audit", "run")


@dataclass(frozen=True)
class CatalogRun:
    """What each step found; steps after the mode's last one are None."""

    pages: DataFrame
    discovered: DataFrame
    products: DataFrame | None = None
    duplicates: DataFrame | None = None
    rejected: DataFrame | None = None
    report: DataFrame | None = None
    snapshot: DataFrame | None = None


def discover(listings: DataFrame, rule: SiteRule, max_pages: int | None = None, max_products: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, links): the walk through the site's listings and the product links of its pages, both within one budget.

    ``listings`` has listing_url, page, url and html, and may have place (the listing among the
    site's; else they go by address) and next_url (else the address of the next stored page).
    """
    keys = ["listing_url", "page"]
    if "place" not in listings.columns:
        listings = listings.withColumn("place", F.lit(0))
    if "next_url" not in listings.columns:
        after = listings.select("listing_url", (F.col("page") - 1).alias("page"), F.col("url").alias("next_url"))
        listings = listings.join(after, keys, "left")
    found = crawl.links(listings).join(listings.select("url", "listing_url", "page"), "url")
    products = found.where(crawl.same_host(F.col("target"), rule.hosts[0]) & (crawl.classify(F.col("target"), rule) == "product"))
    seen = write_table(crawl.first_seen(products.groupBy(*keys, "target").agg(F.min("position").alias("position")), "listing_url", "page", "target", "position"), "run-links-seen")
    counts = crawl.page_progress(seen, "listing_url", "page")
    every = listings.join(counts, keys, "left").na.fill(0, ["product_count", "new_in_listing"])
    pages = write_table(walks.walk(every.select(F.lit(rule.id).alias("site"), "place", F.col("listing_url").alias("listing"), "page", "url", "next_url", "product_count", "new_in_listing"), max_pages, max_products), "run-walk")
    new = seen.where("new_in_listing").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("position")))
    links = new.join(pages.select(F.col("listing").alias("listing_url"), "page", "place", "products"), keys).where("nth <= products")
    return pages.withColumnRenamed("listing", "listing_url"), links.select("place", *keys, "position", F.col("target").alias("url"))


def run(listings: DataFrame, details: DataFrame, rule: SiteRule, mode: str = "audit", platform: str = "generic", stored: DataFrame | None = None, run_at: Column | None = None, max_pages: int | None = None, max_products: int | None = None) -> CatalogRun:
    """Steps up to ``mode``; ``details`` (url, html) are the stored product pages, ``stored`` the inventory that a run extends. A run keeps to the site's limits where none are given."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "run":
        max_pages, max_products = rule.limits(max_pages, max_products)
    pages, links = discover(listings, rule, max_pages, max_products)
    pages, links = write_table(pages, "run-pages"), write_table(links, "run-links")
    if mode == "discover":
        return CatalogRun(pages, links)
    order = links.groupBy("url").agg(F.min(F.struct(F.col("place").alias("listing"), "listing_url", "page", "position")).alias("found_at"))
    wanted = details.withColumn("url", urls.catalog_url(F.col("url"))).join(order.select("url"), "url", "left_semi")
    records = profiles.extract_pages(platform, wanted)
    # The order of arrival: a page's first place in the listings, then the record's place on it.
    on_page = F.coalesce(*(F.col(c).cast("int") for c in ("card", "place") if c in records.columns), F.lit(0)).alias("on_page")
    named = records.select("*", on_page).drop("card", "place").join(order, "url")
    placed = conform(named.withColumn(ORDER, F.struct("found_at.*", "on_page")).drop("found_at", "on_page", "url"))
    extracted = write_table(placed, "run-products")
    products, duplicates = dedupe.normalize_catalog(extracted, "UYU")
    valid = write_table(dedupe.merge_products(quality.gate(products, rule)), "run-valid")
    rejected = dedupe.validate(products, valid)
    limited = walks.walk_results(pages.limit(0).select("site").unionAll(listings.sparkSession.range(1).select(F.lit(rule.id))), pages, max_pages, max_products).first()["limited"]
    report = audit.pipeline_counts(links, extracted, valid, limited, duplicates.count(), rejected.count())
    snapshot = None
    if mode == "run" and stored is not None:
        snapshot = inventory.upsert(stored, valid, f"https://{rule.hosts[0]}", F.current_timestamp() if run_at is None else run_at)
    return CatalogRun(pages, links, valid, duplicates, rejected, report, snapshot)
