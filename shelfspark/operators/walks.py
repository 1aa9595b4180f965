"""Walks over a site's stored pages: one budget for all its listings, and sitemaps from their index down.

Both need numbers along an order that no key splits (all pages of a site), which ``ordered``
gives without one task for a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import urls
from ..shared import drop_tables, write_table
from .ordered import running_totals
from .rules import SiteRule, any_match

_PLACE = "__place"


def walk(pages: DataFrame, max_pages: int | None = None, max_products: int | None = None) -> DataFrame:
    """The pages that a walk over each site reads, in order: one budget for all of a site's listings.

    ``pages`` has site, place (of the listing among its site's), listing, page, url, next_url
    (null on a listing's last page) and new_in_listing. Result: these with ``number``,
    ``products`` (what the budget leaves of the page's new ones), ``so_far`` and ``reason``,
    null but on the site's last page.

    A page ends the walk, in this order: with ``max_products`` if it has more new products
    than are left, or uses up what is left and names a next page; not at all if it names none,
    when the next listing begins; with ``no_progress`` if nothing is new; with
    ``repeated_page`` if the next page is one that the listing had; with ``max_pages`` if no
    page is left. A next listing is begun only if pages, then products, are left. A next page
    that is not stored ends its listing.
    """
    if max_pages is not None and max_pages <= 0 or max_products is not None and max_products <= 0:
        pages = pages.limit(0)
    stay = _until_listing_ends(pages)
    order = ["place", "listing", "page"]
    numbered = running_totals(stay, "site", order, ["new_in_listing"])
    last = stay.groupBy("site").agg(F.max(F.struct("place", "listing")).alias("last_listing"))
    rows = numbered.join(last.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    so_far = F.col("before_new_in_listing") + F.col("new_in_listing")
    more = F.struct("place", "listing") < F.col("last_listing")
    full = so_far >= max_products if max_products is not None else F.lit(False)
    over = so_far > max_products if max_products is not None else F.lit(False)
    out = F.col("number") >= max_pages if max_pages is not None else F.lit(False)
    following = F.col("next_url").isNotNull()
    reason = (
        F.when(over | full & following, "max_products")
        .when(~following, F.when(more & out, "max_pages").when(more & full, "max_products"))
        .when(F.col("stop").isNotNull(), F.col("stop"))
        .when(out, "max_pages")
    )
    rows = write_table(rows.withColumn("reason", reason), "walked")
    ends = rows.groupBy("site").agg(F.min(F.when(F.col("reason").isNotNull(), F.col("number"))).alias("end"), F.max("number").alias("all_pages"))
    joined = rows.join(ends.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site"))).where(F.col("end").isNull() | (F.col("number") <= F.col("end")))
    left = F.col("new_in_listing") if max_products is None else F.least(F.col("new_in_listing"), F.lit(max_products) - F.col("before_new_in_listing"))
    at_end = F.when(F.col("end").isNull() & (F.col("number") == F.col("all_pages")), "catalog_end").otherwise(F.col("reason"))
    return joined.select(*pages.columns, "number", left.alias("products"), (F.col("before_new_in_listing") + left).alias("so_far"), at_end.alias("reason"))


def _until_listing_ends(pages: DataFrame) -> DataFrame:
    """Each listing's pages up to the one that ends it, with ``stop``: why the whole walk ends there, if it does."""
    key = ["site", "listing"]
    firsts = pages.groupBy(*key, "url").agg(F.min("page").alias("_first")).withColumnsRenamed({"site": "_site", "listing": "_listing", "url": "_url"})
    met = pages.join(firsts, _all_alike(key) & (F.col("next_url") == F.col("_url")), "left").drop("_site", "_listing", "_url")
    stop = F.when(F.col("next_url").isNull(), "last").when(F.col("new_in_listing") == 0, "no_progress").when(F.col("_first") <= F.col("page"), "repeated_page")
    stopped = met.withColumn("stop", stop).drop("_first")
    ends = stopped.where("stop is not null").groupBy(*key).agg(F.min("page").alias("_end")).withColumnsRenamed({"site": "_site", "listing": "_listing"})
    kept = stopped.join(ends, _all_alike(key), "left").where(F.col("_end").isNull() | (F.col("page") <= F.col("_end"))).drop("_site", "_listing", "_end")
    return kept.withColumn("stop", F.when(F.col("stop") != "last", F.col("stop")))


def _all_alike(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return out


def walk_results(sites: DataFrame, walked: DataFrame, max_pages: int | None = None, max_products: int | None = None) -> DataFrame:
    """(site, pages, products, reason, limited) for each of ``sites`` (site); what has no page ended at once."""
    done = walked.groupBy("site").agg(F.count("*").alias("pages"), F.sum("products").alias("products"), F.max("reason").alias("reason")).withColumnRenamed("site", "_site")
    at_once = "max_pages" if max_pages is not None and max_pages <= 0 else "max_products" if max_products is not None and max_products <= 0 else "catalog_end"
    joined = sites.join(done, F.col("site").eqNullSafe(F.col("_site")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    found = joined.select("site", zero("pages"), zero("products"), F.coalesce("reason", F.lit(at_once)).alias("reason"))
    return found.withColumn("limited", F.col("reason") != "catalog_end")


#: Where a shop's sitemaps usually begin.
SITEMAP_SEEDS = ("/wp-sitemap.xml", "/sitemap_index.xml", "/sitemap.xml")
_LOC = "(?is)<loc\\b[^>]*>(.*?)</loc>"


def sitemap_seeds(base: Column) -> Column:
    """Their addresses on the host of an address."""
    return F.transform(F.array(*map(F.lit, SITEMAP_SEEDS)), lambda path: F.concat(F.regexp_extract(base, "(?i)^(https?://[^/?#]+)", 1), path))


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(url, place, location): the distinct addresses of stored sitemaps (url, status, body), each at its first place; other bodies have none."""
    good = sitemaps.where(F.col("status").between(200, 299) & F.col("body").rlike("(?i)<(?:urlset|sitemapindex)\\b"))
    found = good.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(_LOC), F.lit(1))).alias("place", "loc"))
    bare = texts.decode_entities(texts.clean_text(F.regexp_replace("loc", "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1")))
    named = found.select("url", "place", urls.resolve_url(F.col("url"), bare).alias("location")).where("location is not null")
    return named.groupBy("url", "location").agg(F.min("place").alias("place"))


def sitemap_walk(seeds: DataFrame, sitemaps: DataFrame, rule: SiteRule, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(documents, products) of a walk from ``seeds`` (url, place) through ``sitemaps`` (url, status, body), first come first served.

    documents: (url, number, product_count) of those that are sitemaps, ``product_count`` with
    all before; products: (url, number), the document that had it first. An address is visited
    once, whether a sitemap is there or not, and ``limit`` counts all visits. Levels are tables;
    numbers within a level come from the order of the level before, not from one task.
    """
    located = write_table(sitemap_locations(sitemaps), "sitemap-locations")
    host = F.lit(rule.hosts[0])
    allowed = (urls.hostname(F.col("location")) == host) & ~any_match(F.col("location"), rule.exclude_patterns)
    product = any_match(F.col("location"), rule.product_patterns)
    links = write_table(located.where(allowed).select("url", "place", "location", product.alias("product"), F.col("location").rlike("(?i)\\.xml(?:\\?|$)").alias("xml")), "sitemap-links")
    drop_tables(located)
    level = seeds.groupBy("url").agg(F.min(F.struct(F.lit(0).cast("bigint").alias("above"), F.col("place").cast("bigint").alias("place"))).alias(_PLACE))
    visited: DataFrame | None = None
    count = 0
    while count < limit:
        fresh = level if visited is None else level.join(visited.select("url"), "url", "left_anti")
        numbered = running_totals(fresh.withColumn("all", F.lit(1)), "all", [_PLACE], []).select("url", (F.col("number") + count).alias("number"))
        step = write_table(numbered.where(F.col("number") <= limit), "sitemap-level")
        n = step.count()
        if not n:
            break
        count += n
        visited = step if visited is None else write_table(visited.unionByName(step), "sitemaps-visited")
        found = links.where("xml and not product").join(step, "url")
        level = found.groupBy(F.col("location").alias("url")).agg(F.min(F.struct(F.col("number").alias("above"), F.col("place").cast("bigint").alias("place"))).alias(_PLACE))
    if visited is None:
        visited = seeds.limit(0).select("url", F.lit(0).cast("bigint").alias("number"))
    products = links.where("product").join(visited, "url").groupBy(F.col("location").alias("url")).agg(F.min("number").alias("number"))
    is_sitemap = sitemaps.where(F.col("status").between(200, 299) & F.col("body").rlike("(?i)<(?:urlset|sitemapindex)\\b")).select("url").distinct()
    own = products.groupBy("number").agg(F.count("*").alias("n"))
    counted = visited.join(is_sitemap, "url").join(own, "number", "left").select("url", "number", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("all"))
    documents = running_totals(counted.withColumnRenamed("number", "visit"), "all", ["visit"], ["n"])
    return documents.select("url", F.col("visit").alias("number"), (F.col("before_n") + F.col("n")).alias("product_count")), products


def series(answers: DataFrame, max_items: int | None = None, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pages, items) of listings that are asked page by page until nothing new comes.

    ``answers`` is (series, page, attempt, blank, keys): what each page gave, the keys of its
    records in order. An empty answer is asked once more, up to ``attempts``; the first page
    counts whatever it gives. Later ones end the series, and do not count, if they are missing
    or empty, have no record, or none that is new in the series; a series is full at
    ``max_items`` records. pages: (series, page, n, new, so_far); items: (series, page, place, key).
    """
    tried = answers.where(F.col("attempt") <= attempts)
    best = F.min_by(F.struct("blank", "keys"), F.struct(F.col("blank"), "attempt"))
    asked = tried.groupBy("series", "page").agg(best.alias("a")).select("series", "page", F.col("a.blank").alias("blank"), F.when(~F.col("a.blank"), F.col("a.keys")).alias("keys"))
    asked = write_table(asked, "series-pages")
    found = asked.select("series", "page", F.posexplode("keys").alias("place", "key")).where("key is not null")
    firsts = found.groupBy("series", "key").agg(F.min(F.struct("page", "place")).alias("at")).select("series", "key", "at.page", "at.place")
    new = firsts.groupBy("series", "page").agg(F.count("*").alias("new"))
    all_ = found.groupBy("series", "page").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = asked.select("series", "page", "blank").join(all_, ["series", "page"], "left").join(new, ["series", "page"], "left").select("series", "page", "blank", zero("n"), zero("new"))
    rows = running_totals(counted, "series", ["page"], ["new"])
    first = counted.groupBy("series").agg(F.min("page").alias("first_page")).withColumnRenamed("series", "_series")
    rows = rows.join(first, F.col("series").eqNullSafe(F.col("_series"))).drop("_series")
    later = F.col("page") > F.col("first_page")
    stops = later & (F.col("blank") | (F.col("n") == 0) | (F.col("new") == 0) | (F.col("page") - F.col("first_page") + 1 != F.col("number")))
    if max_items is not None:
        stops = stops | later & (F.col("before_new") >= max_items)
    judged = write_table(rows.withColumn("stops", stops), "series-judged")
    ends = judged.where("stops").groupBy("series").agg(F.min("page").alias("end")).withColumnRenamed("series", "_series")
    kept = judged.join(ends, F.col("series").eqNullSafe(F.col("_series")), "left").where(F.col("end").isNull() | (F.col("page") < F.col("end")))
    so_far = F.col("before_new") + F.col("new")
    pages = kept.select("series", "page", "n", "new", (so_far if max_items is None else F.least(so_far, F.lit(max_items))).alias("so_far"), "before_new")
    items = firsts.join(pages.select(F.col("series").alias("_series"), F.col("page").alias("_page"), "before_new"), _all_alike(["series", "page"]))
    if max_items is not None:
        nth = F.row_number().over(Window.partitionBy("series", "page").orderBy("place"))
        items = items.withColumn("nth", nth + F.col("before_new")).where(F.col("nth") <= max_items)
    return pages.drop("before_new"), items.select("series", "page", "place", "key")


def full_listing(url: Column, total: Column, parameter: str) -> Column:
    """The address of a listing with all its results on one page: ``parameter`` set to their number; the address itself if that is not known."""
    setting = F.concat(F.lit(f"{parameter}="), total.cast("string"))
    there = url.rlike(f"[?&]{parameter}=")
    joint = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    changed = F.when(there, F.regexp_replace(url, f"(?<=[?&]){parameter}=[^&#]*", setting)).otherwise(F.concat(url, joint, setting))
    return F.when(total.isNotNull(), changed).otherwise(url)
