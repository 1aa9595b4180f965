"""Merging of records that are one product, in order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, urls
from ..functions.text import clean_text, fold
from ..schema import ORDER
from ..shared import write_table
from .ordered import previous


def product_key() -> Column:
    """``url|`` and the address, else ``name|`` and name and brand; null if there is neither."""
    url, name = clean_text(F.col("source_url")), fold(F.col("product_name"))
    brand = F.coalesce(F.nullif(fold(F.col("brand")), F.lit("")), F.lit("no-brand"))
    return F.when(url.isNotNull(), F.concat(F.lit("url|"), F.lower(url))).when(name != "", F.concat_ws("|", F.lit("name"), name, brand))


def catalog_key() -> Column:
    """The address to fetch, else the code, else the name."""
    url = F.lower(urls.catalog_url(F.col("source_url")))
    other = lambda c, p: F.when(F.col(c) != "", F.concat(F.lit(p), F.lower(F.col(c))))
    return F.coalesce(F.concat(F.lit("url:"), url), other("sku", "sku:"), other("product_name", "name:"))


def merge_records(
    records: DataFrame,
    key: Column,
    lists: dict[str, Callable[[Column], Column]] | None = None,
    unions: tuple[str, ...] = (),
) -> DataFrame:
    """One row per key, keyless rows gone: the last known value of each column, lists merged, the first one's place.

    ``lists`` says for a column how texts become keys for merging; entries are aggregated by
    key before they are gathered, so a group holds its distinct entries and not its records.
    ``unions`` are columns of codes. Lists of a record without a partner stay as they are.
    """
    lists = lists or {}
    keyed = records.withColumn("_key", key).where(F.col("_key").isNotNull())
    plain = [c for c in records.columns if c not in lists and c not in unions and c != ORDER]
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ORDER))).alias(c)
    many = [*lists, *unions]
    merged = keyed.groupBy("_key").agg(
        F.min(ORDER).alias(ORDER), F.count("*").alias("_n"), *(last(c) for c in plain), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ORDER))).alias(c) for c in many)
    )
    if not many:
        return merged.drop("_key", "_n").select(*records.columns)
    entry = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.filter(F.transform(F.col(c), clean_text), lambda x: x.isNotNull()).alias("list")) for c in many))).alias("e")
    flat = keyed.select("_key", ORDER, entry).select("_key", ORDER, "e.name", F.posexplode("e.list").alias("pos", "value"))
    fold_key = F.col("value")
    for c, how in lists.items():
        fold_key = F.when(F.col("name") == c, how(F.col("value"))).otherwise(fold_key)
    place = F.struct(ORDER, "pos")
    distinct = flat.groupBy("_key", "name", fold_key.alias("fold")).agg(F.min(place).alias("place"), F.max_by("value", place).alias("value"))
    gathered = distinct.groupBy("_key").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.struct("place", "value")))), lambda x: x["value"]).alias(f"_{c}") for c in many))
    out = merged.join(gathered, "_key", "left")
    pick = lambda c: F.when((F.col("_n") > 1) & (F.size(f"_{c}") > 0), F.col(f"_{c}")).when(F.col("_n") > 1, F.lit(None)).otherwise(F.col(c)).alias(c)
    return out.select(*(pick(c) if c in many else F.col(c) for c in records.columns))


MERGED_LISTS = ("image_urls", "compatible_brands", "compatible_vehicles", "compatible_models", "compatible_versions")


def merge_products(products: DataFrame) -> DataFrame:
    """Records of one product become one; an entry for other brands goes where real brands are known."""
    merged = merge_records(products, product_key(), dict.fromkeys(MERGED_LISTS, fold), ("quality_warnings",))
    brands = F.col("compatible_brands")
    real = F.filter(brands, lambda x: fold(x) != arrays.OTHER_BRANDS)
    return merged.withColumn("compatible_brands", F.when((F.size(brands) > 1) & (F.size(real) > 0), real).otherwise(brands))


def merge_by_address(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Two lists of records, the second one's values before the first one's; only the address is a key.

    The order of what comes out is (side, the record's own), whatever that is.
    """
    side = lambda df, n: df.withColumn(ORDER, F.struct(F.lit(n).alias("side"), F.col(ORDER).alias("own")))
    both = side(base, 0).unionByName(side(incoming, 1))
    return merge_records(both, F.nullif(F.lower(F.trim("source_url")), F.lit("")), dict.fromkeys(MERGED_LISTS, lambda x: F.lower(x)))


def normalize_catalog(products: DataFrame, currency: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, duplicates): one record per key, the last one's values; records without a key stay. A duplicate names what it repeats."""
    keyed = products.withColumn("_key", F.coalesce(catalog_key(), F.concat(F.lit("anonymous:"), F.col(ORDER).cast("string"))))
    merged = merge_records(keyed.drop("_key"), F.coalesce(catalog_key(), F.concat(F.lit("anonymous:"), F.col(ORDER).cast("string"))))
    out = merged.withColumn("source_url", F.coalesce(urls.catalog_url(F.col("source_url")), F.col("source_url")))
    if currency:
        out = out.withColumn("currency", F.coalesce("currency", F.lit(currency)))
    reason = F.when(F.col("_key").startswith("sku:"), "sku").otherwise("canonical_url")
    again = previous(keyed.select("_key", ORDER, "source_url"), "_key", [ORDER], "source_url").where("not is_first")
    return out, again.select(F.col("source_url").alias("url"), F.col("previous").alias("duplicate_of"), reason.alias("reason"))


def validate(products: DataFrame, valid: DataFrame) -> DataFrame:
    """(url, reason) of the products whose address, or name, no valid record has."""
    key = F.coalesce("source_url", "product_name")
    reason = F.coalesce(F.nullif(F.array_join("quality_warnings", ", "), F.lit("")), F.lit("quality_gate"))
    return products.withColumn("_key", key).join(valid.select(key.alias("_key")).distinct(), "_key", "left_anti").select(F.col("source_url").alias("url"), reason.alias("reason"))


def last_wins(df: DataFrame, key: Column, order: str = ORDER) -> DataFrame:
    """The last row of each key, at the first one's place. Aggregates before the shuffle."""
    row = F.struct(*df.columns)
    best = df.withColumn("_key", key).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max_by(row, F.col(order)).alias("row"), F.min(order).alias("_first"))
    return best.select(*(F.col("_first").alias(c) if c == order else F.col(f"row.{c}").alias(c) for c in df.columns))


def keep_newest(df: DataFrame, key: str, updated: str, tie: str) -> DataFrame:
    """The row of each key that was updated last; of equal times the one of the smallest ``tie``. Aggregates before each shuffle."""
    row = F.struct(*df.columns)
    # Orders are structs, as rows whose time or tie is null count too: null is the earliest.
    each = df.groupBy(F.col(key).alias("_key"), F.col(updated).alias("_updated")).agg(F.min_by(row, F.struct(tie)).alias("row"))
    return each.groupBy("_key").agg(F.max_by("row", F.struct("_updated")).alias("row")).select("row.*")


def resolve_two_keys(df: DataFrame, site: str, url: str, sku: str) -> DataFrame:
    """Adds ``_entity``: the address under which a record is kept if its code was seen under an earlier address of the site.

    In order of arrival a code is filed under the first address known with it, and all its
    records from then on belong to that one; others keep their own. The first addresses are
    aggregated by site and code, and are a table of their own, so that a large site or code
    can be split.
    """
    rows = df.withColumn("_sku", F.nullif(F.lower(clean_text(F.col(sku))), F.lit("")))
    known = rows.where(F.col("_sku").isNotNull() & (F.col(url) != ""))
    first = write_table(known.groupBy(F.col(site).alias("_site"), F.col("_sku").alias("_code")).agg(F.min_by(url, ORDER).alias("_filed"), F.min(ORDER).alias("_from")), "filed-codes")
    joined = rows.join(first, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_sku") == F.col("_code")), "left")
    return joined.select(*df.columns, F.when(F.col(ORDER) >= F.col("_from"), F.col("_filed")).otherwise(F.col(url)).alias("_entity"))


def merge_two_keys(df: DataFrame, site: str, url: str = "source_url", sku: str = "sku") -> tuple[DataFrame, DataFrame]:
    """(products, counts): the records of a site that are one product by address or by code, merged in order of arrival.

    A product's address is the one it is filed under; records that have neither go. Counts
    are (site, n_records, n_duplicates), of records that were kept.
    """
    filed = resolve_two_keys(df, site, url, sku).where(F.coalesce("_entity", F.lit("")) != "")
    named = filed.withColumn(url, F.col("_entity")).drop("_entity")
    key = F.to_json(F.struct(F.col(site).alias("site"), F.col(url).alias("url")))
    lists = {c: fold for c in MERGED_LISTS if c in df.columns}
    merged = merge_records(named, key, lists, tuple(c for c in ("quality_warnings",) if c in df.columns))
    each = named.groupBy(site, url).agg(F.count("*").alias("n"))
    counts = each.groupBy(site).agg(F.sum("n").alias("n_records"), (F.sum("n") - F.count("*")).alias("n_duplicates"))
    return merged, counts
