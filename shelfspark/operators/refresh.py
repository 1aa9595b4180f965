"""Updates of an inventory from pages that were read again: what would change, the next snapshot, and counts by reason.

An update is a join of the snapshot with what was found, by address; a field is written only
where it differs, so a second run over the same pages changes nothing. Nothing is updated in
place: write the result as the next snapshot, or leave it (a dry run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, urls
from . import brands, inventory

#: Why a row stays as it is, or does not.
NOT_ASKED, NO_PAGE, NOTHING_FOUND, UNCHANGED, UPDATE = "not_asked", "no_page", "nothing_found", "unchanged", "update"
# Fixed value: what an image's address must not hold.
INVALID_IMAGE = "(?i)logo|favicon|brand|branding|placeholder|no-image|sin-imagen|header|footer|whatsapp"

_KEY, _NEW = "__key", "__new"


def one_each(found: DataFrame, key: Column) -> DataFrame:
    """(__key, __new): one row of ``found`` per address; of several the one whose text is the least, whatever their order."""
    row = F.struct(*(F.col(c) for c in found.columns))
    return found.withColumn(_KEY, key).where(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(F.min_by(row, F.to_json(row)).alias(_NEW))


def with_changes(stock: DataFrame, found: DataFrame, values: dict[str, Column], useful: Column, wanted: Column, run_at: Column, apply: bool = True) -> DataFrame:
    """The next snapshot of ``stock`` with ``reason`` and ``changed``, the names of the fields that differ.

    ``found`` (with source_url) is what pages say; ``values`` are fields' next values, of a row's
    own columns and of ``__new``; ``useful`` says whether a page gave anything, ``wanted`` which rows
    are asked for. With ``apply`` false the fields stay, as in a dry run.
    """
    new = one_each(found, urls.canonical_url(F.col("source_url")))
    joined = stock.withColumn("__at", urls.canonical_url(F.col("source_url"))).join(new, F.col("__at") == F.col(_KEY), "left")
    maps = {name for name, kind in stock.dtypes if kind.startswith("map")}
    text = lambda c, name: F.to_json(c) if name in maps else c
    differs = F.array_compact(F.array(*(F.when(~text(v, n).eqNullSafe(text(F.col(n), n)), F.lit(n)) for n, v in values.items())))
    asked = joined.withColumns({f"__next_{n}": v for n, v in values.items()}).withColumn("changed", differs)
    reason = F.when(~F.coalesce(wanted, F.lit(False)), NOT_ASKED).when(F.col(_NEW).isNull(), NO_PAGE).when(~F.coalesce(useful, F.lit(False)), NOTHING_FOUND).when(F.size("changed") == 0, UNCHANGED).otherwise(UPDATE)
    judged = asked.withColumn("reason", reason).withColumn("changed", F.when(F.col("reason") == UPDATE, F.col("changed")).otherwise(F.slice("changed", 1, 0)))
    updated = (F.col("reason") == UPDATE) & F.lit(apply)
    out = judged.withColumns({n: F.when(updated, F.col(f"__next_{n}")).otherwise(F.col(n)) for n in values})
    times = {"updated_at": F.when(updated, run_at).otherwise(F.col("updated_at"))} if "updated_at" in stock.columns else {}
    search = {"search_text": F.when(updated, inventory.product_search_text()).otherwise(F.col("search_text"))} if "search_text" in stock.columns else {}
    return out.withColumns(times | search).select(*stock.columns, "reason", "changed")


def counts(snapshot: DataFrame) -> DataFrame:
    """(scanned, refreshed, unchanged, nothing_found, failed) of a snapshot with reasons."""
    n = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    return snapshot.agg(F.count_if(F.col("reason") != NOT_ASKED).alias("scanned"), n(UPDATE).alias("refreshed"), n(UNCHANGED).alias("unchanged"), n(NOTHING_FOUND).alias("nothing_found"), n(NO_PAGE).alias("failed"))


def invalid_image(image: Column) -> Column:
    return F.coalesce(image.rlike(INVALID_IMAGE), F.lit(False))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def backfill_images(stock: DataFrame, found: DataFrame, prefixes: tuple[str, ...], run_at: Column, apply: bool = False, limit: int | None = None) -> DataFrame:
    """The next snapshot with images of ``found`` (source_url, image_url, image_urls) for rows under the prefixes, the newest ``limit`` of them.

    Besides ``reason`` and ``changed``: ``previous_invalid`` and ``new_valid``. A new image counts only
    if its address has no word of ``INVALID_IMAGE``; a missing list is as an empty one.
    """
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.coalesce(F.col("source_url").startswith(p), F.lit(False))
    asked = stock.withColumn("__wanted", wanted)
    if limit is not None:
        newest = asked.where("__wanted").orderBy(F.desc("updated_at"), "id").limit(limit).select(F.col("id").alias("__id")).withColumn("__kept", F.lit(True))
        asked = asked.join(newest, F.col("id") == F.col("__id"), "left").withColumn("__wanted", F.coalesce("__kept", F.lit(False))).drop("__id", "__kept")
    before = asked.withColumn("previous_invalid", F.col("__wanted") & invalid_image(F.col("image_url"))).withColumn("new_valid", F.lit(False))
    image, images = F.col(f"{_NEW}.image_url"), F.col(f"{_NEW}.image_urls")
    valid = F.coalesce(image != "", F.lit(False)) & ~invalid_image(image)
    same_list = _list(images) == _list(F.col("image_urls"))
    values = {"image_url": image, "image_urls": F.when(same_list, F.col("image_urls")).otherwise(images), "new_valid": F.col("__wanted") & valid}
    out = with_changes(before, found, values, valid, F.col("__wanted"), run_at, True)
    # Whether the new image is valid is no field: rows that differ by it alone do not change.
    out = out.withColumn("changed", F.array_remove("changed", "new_valid")).withColumn("reason", F.when((F.col("reason") == UPDATE) & (F.size("changed") == 0), UNCHANGED).otherwise(F.col("reason")))
    out = out.withColumn("new_valid", F.col("reason").isin(UPDATE, UNCHANGED)).drop("__wanted")
    if apply:
        return out
    own = stock.select(F.col("id").alias("__id"), F.struct(*(c for c in stock.columns if c != "id")).alias("__old"))
    back = out.join(own, F.col("id").eqNullSafe(F.col("__id")))
    return back.select("id", *(F.col(f"__old.{c}").alias(c) for c in stock.columns if c != "id"), *(c for c in out.columns if c not in stock.columns))


def backfill_summary(snapshot: DataFrame, applied: bool) -> DataFrame:
    """One row of counts of ``backfill_images``."""
    n = lambda test: F.count_if(test)
    return snapshot.where(F.col("reason") != NOT_ASKED).agg(
        F.count("*").alias("total_candidates"), n(F.col("previous_invalid")).alias("current_invalid"), n(F.col("new_valid")).alias("new_valid"), n(~F.col("new_valid") & (F.col("reason") != NO_PAGE)).alias("without_valid"),
        n(F.col("reason") == UPDATE).alias("would_update"), n((F.col("reason") == UPDATE) & F.lit(applied)).alias("updated"), n(F.col("reason") == NO_PAGE).alias("errors"),
    )


def _merged(name: str) -> Column:
    merge = arrays.merge_brands if name == "compatible_brands" else arrays.merge_texts
    both = F.concat(_list(F.col(name)), _list(F.col(f"{_NEW}.{name}")))
    # A list to which nothing is added stays as it is written.
    return F.when(F.size(_list(F.col(f"{_NEW}.{name}"))) == 0, F.col(name)).otherwise(merge(both))


COMPATIBLE = ("compatible_brands", "compatible_vehicles", "compatible_models", "compatible_versions")


def _of_site(site: str | None) -> Column:
    return F.col("source_url").isNotNull() & (F.contains(F.lower("site"), F.lit(site.strip().lower())) if site and site.strip() else F.lit(True))


def _speaks_of_vehicles() -> Column:
    return (F.size(_list(F.col(f"{_NEW}.compatible_models"))) > 0) | (F.size(_list(F.col(f"{_NEW}.compatible_versions"))) > 0)


def refresh_compatibility(stock: DataFrame, found: DataFrame, run_at: Column, site: str | None = None) -> DataFrame:
    """The next snapshot: rows without models or versions get what their pages list (``found``: source_url and the lists), merged with what they have."""
    bare = lambda c: F.size(_list(F.col(c))) == 0
    wanted = _of_site(site) & (bare("compatible_models") | bare("compatible_versions"))
    return with_changes(stock, found, {c: _merged(c) for c in COMPATIBLE}, _speaks_of_vehicles(), wanted, run_at)


def refresh_links(stock: DataFrame, found: DataFrame, site: str, run_at: Column) -> DataFrame:
    """The next snapshot: rows of a site get what their pages say now; known values go over stored ones, lists of vehicles are merged.

    ``found`` has source_url, product columns, and ``is_detail``: whether the page is a product's;
    other pages count only for the vehicles that they list.
    """
    have = [c for c in found.columns if c in stock.columns and c not in ("id", "site", "source_url", "created_at", "updated_at", "last_seen_at", "search_text", *COMPATIBLE)]
    detail = F.coalesce(F.col(f"{_NEW}.is_detail"), F.lit(False))
    values = {c: F.when(detail, F.coalesce(F.col(f"{_NEW}.{c}"), F.col(c))).otherwise(F.col(c)) for c in have} | {c: _merged(c) for c in COMPATIBLE if c in found.columns}
    useful = detail | _speaks_of_vehicles() if {"compatible_models", "compatible_versions"} <= set(found.columns) else detail
    return with_changes(stock, found, values, useful, _of_site(site), run_at)


def changed_links(links: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The table of brand links after those of changed rows were inferred again."""
    changed = snapshot.where(F.col("reason") == UPDATE)
    return brands.replace_links(links, brands.brand_links(changed))
