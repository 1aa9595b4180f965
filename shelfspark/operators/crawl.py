"""Discovery over stored pages: links, first sightings by listing, pagination, and reach through the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import selectors
from .rules import SiteRule, any_match

LINK = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']+)[\"']"


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, position, href, target): the links of each page in page order; the target is absolute and without tracking."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("position", "href"))
    return found.withColumn("target", urls.catalog_url(urls.resolve_url(F.col("url"), F.col("href"))))


def same_host(url: Column, host: str) -> Column:
    """On the host or one below it."""
    host = host.lower().removeprefix("www.")
    return F.coalesce((urls.hostname(url) == host) | urls.hostname(url).endswith(f".{host}"), F.lit(False))


def classify(url: Column, rule: SiteRule) -> Column:
    """``product``, ``category`` or ``none``; a product's pattern goes first."""
    excluded = any_match(url, rule.exclude_patterns)
    return F.when(excluded, "none").when(any_match(url, rule.product_patterns), "product").when(any_match(url, rule.category_patterns), "category").otherwise("none")


def first_seen(found: DataFrame, listing: str, page: str, link: str, position: str | None = None) -> DataFrame:
    """``found`` with ``new_in_listing``: whether the listing has the link here for the first time.

    First places are aggregated by listing and link, and joined back: a listing of very many
    pages is no single task.
    """
    place = F.struct(*(F.col(c) for c in (page, position) if c))
    first = found.groupBy(listing, link).agg(F.min(place).alias("_first"))
    return found.join(first, [listing, link]).withColumn("new_in_listing", F.col("_first") == place).drop("_first")


def page_progress(seen: DataFrame, listing: str, page: str) -> DataFrame:
    """(listing, page, product_count, new_in_listing) of links from ``first_seen``."""
    return seen.groupBy(listing, page).agg(F.count("*").alias("product_count"), F.count_if("new_in_listing").alias("new_in_listing"))


def reachable(seeds: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int | None = None) -> DataFrame:
    """(node, depth): what can be reached over ``edges`` (src, dst) in so many steps, each at its least depth.

    Each step is a join with the edges and an anti join with what was seen.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


def prioritize(candidates: DataFrame, url: str, order: str, rule: SiteRule) -> DataFrame:
    """Catalog-like addresses first, each kind in its order."""
    like = any_match(F.col(url), rule.product_patterns) | any_match(F.col(url), rule.category_patterns) | F.lower(url).rlike("product|catalog|shop|tienda|categoria|repuesto")
    return candidates.orderBy(F.when(like, 0).otherwise(1), order)


def link_score(url: Column, label: Column, rule: SiteRule) -> Column:
    """How promising a link is: a product's pattern, a category's, words in address and label, less depth."""
    path = F.coalesce(urls.path_of(url), F.lit("/"))
    return (
        F.when(any_match(url, rule.product_patterns), 100).otherwise(0)
        + F.when(any_match(url, rule.category_patterns), 50).otherwise(0)
        + F.when(F.lower(url).rlike("product|repuesto|articulo|catalog"), 20).otherwise(0)
        + F.when(F.lower(F.coalesce(label, F.lit(""))).rlike("ver|comprar|detalle|producto"), 10).otherwise(0)
        - F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    )


#: Links to the next page where a site has no other mark for them.
NEXT_LINK = "a[rel=next], link[rel=next], .next a[href], a.next[href]"


def next_link(pages: DataFrame, selector: str = NEXT_LINK) -> DataFrame:
    """(url, next_url): the address that a page's link to the next one gives; null if it has none."""
    found = selectors.find(pages.select("url", "html"), {"links": (selector, {"href": "href"})})
    return found.select("url", urls.catalog_url(urls.resolve_url(F.col("url"), F.get("_found.links", F.lit(0))["href"])).alias("next_url"))


def next_by_parameter(url: Column, page: Column, parameter: str = "page", max_pages: int | None = None) -> Column:
    """The address of the page after ``page`` by a parameter, which is set or replaced; null beyond ``max_pages``."""
    number = (page + 1).cast("string")
    there = url.rlike(f"[?&]{parameter}=")
    joint = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    following = F.when(there, F.regexp_replace(url, f"([?&]{parameter}=)[^&#]*", F.concat(F.lit("$1"), number))).otherwise(F.concat(url, joint, F.lit(f"{parameter}="), number))
    return following if max_pages is None else F.when(page + 1 <= max_pages, following)


def page_summary(pages: DataFrame, links: str = "ul.pagination a[href]", current: str = "ul.pagination li.active span", number: str = "data-ci-pagination-page") -> DataFrame:
    """(url, current_page, next_url, last_url) of listing pages by their pagination: the link marked as next, else the least page after the current one."""
    wanted = {"links": (links, {"href": "href", "rel": "rel", "number": number, "label": "text"}), "current": (current, {"label": "text"})}
    parsed = selectors.find(pages.select("url", "html"), wanted)
    one = lambda n: F.struct(n["node"].alias("node"), n["href"].alias("href"), F.lower(F.coalesce(n["rel"], F.lit(""))).alias("rel"), n["number"].try_cast("int").alias("page"), n["label"].alias("label"))
    now = F.get("_found.current", F.lit(0))["label"]
    found = parsed.select("url", F.transform("_found.links", one).alias("links"), F.regexp_extract(now, "([0-9]+)", 1).try_cast("int").alias("current_page"))
    last = lambda test: F.get(F.reverse(F.filter("links", test)), F.lit(0))["href"]
    after = F.array_min(F.transform(F.filter("links", lambda x: x["page"] > F.col("current_page")), lambda x: F.struct(x["page"].alias("page"), x["node"].alias("node"), x["href"].alias("href"))))["href"]
    absolute = lambda c: urls.catalog_url(urls.resolve_url(F.col("url"), F.col(c)))
    named = found.select("url", "current_page", F.coalesce(last(lambda x: F.contains(x["rel"], F.lit("next"))), after).alias("next"), last(lambda x: F.contains(x["rel"], F.lit("last")) | (x["label"] == "»")).alias("last"))
    return named.select("url", "current_page", absolute("next").alias("next_url"), absolute("last").alias("last_url"))


def declared_pages(pages: DataFrame, list_selector: str = ".aListProductos", of_page: str = "data-tot", of_all: str = "data-totabs") -> DataFrame:
    """(url, page_items, total_results, n_pages) as a listing's attributes declare them; pages without them give no row."""
    lists = selectors.find(pages.select("url", "html"), {"lists": (list_selector, {"items": of_page, "all": of_all})})
    box = F.get(F.filter("_found.lists", lambda n: n["items"].isNotNull() & n["all"].isNotNull()), F.lit(0))
    found = lists.select("url", box["items"].try_cast("bigint").alias("page_items"), box["all"].try_cast("bigint").alias("total_results"))
    return found.where("page_items is not null and total_results is not null").withColumn("n_pages", F.ceil(F.col("total_results") / F.when(F.col("page_items") > 0, F.col("page_items"))).cast("bigint"))
