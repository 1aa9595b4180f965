"""The inventory: filters, ordered pages, statistics, and upserts as new snapshots.

A row is (id, site, source_url, product columns, created_at, updated_at, last_seen_at,
search_text); brand links are a table (inventory_id, brand_id, confidence, evidence).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, price, text, urls
from . import brands, dedupe
from .rules import RuleBook

# What each availability filter accepts.
AVAILABLE = ("in_stock", "in stock", "available", "available now")
UNAVAILABLE = ("out_of_stock", "out of stock", "unavailable", "agotado", "sin stock")
MOST_ROWS = 200


@dataclass(frozen=True)
class Filters:
    """What a query asks for; values that mean nothing are ignored."""

    site: str | None = None
    search: str | None = None
    price_state: str | None = None
    availability: str | None = None
    vehicle_brand: str | None = None
    price_order: str | None = None


def product_search_text() -> Column:
    lists = [arrays.list_text(F.col(c)) for c in ("compatible_vehicles", "compatible_models", "compatible_versions", "compatible_brands")]
    return text.search_text(*map(F.col, ("product_name", "sku", "brand", "category", "description")), *lists, arrays.map_text(F.col("attributes")))


def _no_price() -> Column:
    return F.coalesce(F.trim("price"), F.lit("")) == ""


def conditions(filters: Filters, rules: RuleBook = RuleBook()) -> Column:
    """All filters but the brand's, as one predicate."""
    found = F.lit(True)
    if filters.site and filters.site.strip():
        hosts = rules.hosts_for(filters.site)
        found = found & (urls.inventory_host(F.col("site")).isin(hosts) if hosts else F.lit(False))
    for token in text.search_tokens(filters.search or ""):
        found = found & F.contains(F.col("search_text"), F.lit(token))
    state = (filters.price_state or "").strip().lower()
    if state == "with-price":
        found = found & ~_no_price()
    elif state == "without-price":
        found = found & _no_price()
    stock, value = (filters.availability or "").strip().lower(), F.lower(F.coalesce("availability", F.lit("")))
    if stock == "available":
        found = found & value.isin(list(AVAILABLE))
    elif stock == "unavailable":
        found = found & value.isin(list(UNAVAILABLE))
    elif stock == "unknown":
        found = found & F.trim(value).isin("", "unknown")
    return found


def apply_filters(inventory: DataFrame, filters: Filters, links: DataFrame | None = None, rules: RuleBook = RuleBook()) -> DataFrame:
    """The rows that all filters accept; the brand's is a semi join with the links."""
    out = inventory.where(conditions(filters, rules))
    brand = brands.filter_id(filters.vehicle_brand)
    if brand and links is not None:
        out = out.join(links.where(F.col("brand_id") == brand).select(F.col("inventory_id").alias("id")), "id", "left_semi")
    return out


def ordering(filters: Filters, tie: str = "id") -> list[Column]:
    """By price where asked, nulls last; then newest first; then by id, so that pages do not overlap."""
    newest = [F.col("updated_at").desc(), F.col(tie).asc()]
    key = price.price_sort_key(F.col("price"))
    return {"asc": [key.asc_nulls_last(), *newest], "desc": [key.desc_nulls_last(), *newest]}.get((filters.price_order or "").strip().lower(), newest)


def clamp(limit: float | None, offset: float | None) -> tuple[int, int]:
    """A page's limit within 1 and ``MOST_ROWS`` (that if not given), its offset not negative."""
    good = lambda x: x is not None and x == x and abs(x) != float("inf")
    return (max(1, min(int(limit), MOST_ROWS)) if good(limit) else MOST_ROWS), (max(0, int(offset)) if good(offset) else 0)


def page(inventory: DataFrame, filters: Filters = Filters(), limit: float | None = None, offset: float | None = None, links: DataFrame | None = None, rules: RuleBook = RuleBook()) -> DataFrame:
    """One page with numeric prices, from a top-k of the filtered rows."""
    n, skip = clamp(limit, offset)
    rows = apply_filters(inventory, filters, links, rules).orderBy(*ordering(filters))
    return rows.offset(skip).limit(n).withColumn("price", price.parse_price(F.col("price")))


def page_with_total(inventory: DataFrame, filters: Filters = Filters(), limit: float | None = None, offset: float | None = None, links: DataFrame | None = None, rules: RuleBook = RuleBook()) -> tuple[DataFrame, int, bool]:
    """(page, total, whether rows follow), all of the same input."""
    n, skip = clamp(limit, offset)
    total = apply_filters(inventory, filters, links, rules).count()
    return page(inventory, filters, n, skip, links, rules), total, skip + min(n, max(0, total - skip)) < total


def count_by_site(inventory: DataFrame, site: str) -> int:
    """Rows whose site is exactly this text."""
    return inventory.where(F.col("site") == site).count()


def fill_search_text(inventory: DataFrame) -> DataFrame:
    """Rows without a search text get one, as a migration of older snapshots does."""
    return inventory.withColumn("search_text", F.when(F.coalesce("search_text", F.lit("")) == "", product_search_text()).otherwise(F.col("search_text")))


def site_stats(inventory: DataFrame, houses: DataFrame) -> DataFrame:
    """(host, label, n) by count and host; the label is a house's (``houses``: host, label), else the host."""
    counts = inventory.groupBy(urls.inventory_host(F.col("site")).alias("host")).agg(F.count("*").alias("n"))
    labels = houses.groupBy("host").agg(F.min("label").alias("label"))
    return counts.join(labels, "host", "left").select("host", F.coalesce("label", "host").alias("label"), "n").orderBy(F.desc("n"), "host")


def brand_stats(inventory: DataFrame, links: DataFrame, brand_rows: DataFrame, filters: Filters = Filters(), rules: RuleBook = RuleBook()) -> DataFrame:
    """(brand_id, label, n) by label. Filters act after the outer joins: a brand without products stays where they accept missing values.

    Filtered products are joined to the links, and their counts to the brands, so that what
    is shuffled last is one row a brand.
    """
    without_brand = replace(filters, vehicle_brand=None)
    keep = conditions(without_brand, rules)
    kept = inventory.where(keep).select(F.col("id").alias("inventory_id"))
    counts = links.join(kept, "inventory_id").groupBy("brand_id").agg(F.count("*").alias("n"))
    linked = links.select("brand_id").distinct().withColumn("linked", F.lit(True))
    empty = inventory.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in inventory.schema))
    accepts_missing = empty.select(F.coalesce(keep, F.lit(False)).alias("k")).scalar()
    joined = brand_rows.join(counts, "brand_id", "left").join(linked, "brand_id", "left")
    stays = F.col("n").isNotNull() | (F.col("linked").isNull() & accepts_missing)
    return joined.where(stays).select("brand_id", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("label")


def upsert(inventory: DataFrame, products: DataFrame, site: str | Column, run_at: Column) -> DataFrame:
    """The next snapshot, with ``change`` (created, updated or kept).

    Products are keyed by canonical address, the last one of a key wins; an update keeps id
    and creation time. Write the result next to the old snapshot, then swap the two.
    """
    named = site if isinstance(site, Column) else F.lit(site)
    fresh = dedupe.last_wins(products.withColumn("source_url", urls.canonical_url(F.col("source_url"))), F.col("source_url"))
    fresh = fresh.withColumn("_site", named).withColumn("_text", product_search_text())
    product = [c for c in fresh.columns if c in inventory.columns and c not in ("id", "site", "source_url", "created_at", "updated_at", "last_seen_at", "search_text")]
    new = fresh.select(F.col("source_url"), "_site", "_text", F.struct(*product).alias("_new"))
    both = inventory.join(new, "source_url", "full_outer")
    hit, known = F.col("_new").isNotNull(), F.col("id").isNotNull()
    own = lambda c, value: F.when(hit, value).otherwise(F.col(c)).alias(c)
    values = {"id": F.coalesce("id", F.sha2("source_url", 256)), "site": own("site", F.col("_site")), "created_at": F.coalesce("created_at", run_at), "updated_at": own("updated_at", run_at), "last_seen_at": own("last_seen_at", run_at), "search_text": own("search_text", F.col("_text"))}
    values |= {c: own(c, F.col(f"_new.{c}")) for c in product}
    change = F.when(hit & known, "updated").when(hit, "created").otherwise("kept")
    return both.select(*(values.get(c, F.col(c)).alias(c) for c in inventory.columns), change.alias("change"))


def upsert_counts(snapshot: DataFrame) -> DataFrame:
    """(created, updated, total) of a snapshot with ``change``."""
    return snapshot.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"), F.count("*").alias("total"))


def needs_compatibility(inventory: DataFrame, site: str | None = None) -> DataFrame:
    """Rows without models or without versions, of sites whose text holds ``site``."""
    bare = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    rows = inventory.where(bare("compatible_models") | bare("compatible_versions"))
    return rows.where(F.contains(F.lower("site"), F.lit(site.lower()))) if site else rows


def overlay(listing: DataFrame, detail: DataFrame, key: str, lists: tuple[str, ...] = dedupe.MERGED_LISTS) -> DataFrame:
    """Listing records with what their detail pages say: known values override, lists are merged, the rest stays."""
    other = detail.select(F.col(key), F.struct(*(c for c in detail.columns if c != key)).alias("_d"))
    joined = listing.join(other, key, "left")
    names = set(detail.columns)
    nothing = F.array().cast("array<string>")

    def value(c: str) -> Column:
        if c == key or c not in names:
            return F.col(c)
        if c in lists:
            return F.when(F.col("_d").isNull(), F.col(c)).otherwise(arrays.merge_texts(F.concat(F.coalesce(c, nothing), F.coalesce(F.col(f"_d.{c}"), nothing)))).alias(c)
        return F.coalesce(F.col(f"_d.{c}"), F.col(c)).alias(c)

    return joined.select(*map(value, listing.columns))


def backfill_images(inventory: DataFrame, found: DataFrame, prefixes: tuple[str, ...], valid: Column) -> DataFrame:
    """Rows under the prefixes with the image found for them and a ``reason``: no_page, no_image, invalid_image, unchanged or update.

    ``found`` is (source_url, new_image); ``valid`` is a predicate on ``new_image``.
    """
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("source_url").startswith(p)
    joined = inventory.where(wanted).join(found.withColumn("_page", F.lit(True)), "source_url", "left")
    reason = F.when(F.col("_page").isNull(), "no_page").when(F.col("new_image").isNull(), "no_image").when(~valid, "invalid_image").when(F.col("new_image").eqNullSafe(F.col("image_url")), "unchanged").otherwise("update")
    return joined.withColumn("reason", reason).drop("_page")


def reset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of the tables that a reset empties, counted before."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
