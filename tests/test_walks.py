"""Walks over sites and sitemaps against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import ordered, walks
from shelfspark.operators.rules import SiteRule

PAGES = "site string, place int, listing string, page int, url string, next_url string, new_in_listing int"


def plain_walk(rows, max_pages, max_products):
    """Pages one after the other; (site, listing, page, products, reason)."""
    inf = float("inf")
    most, room = inf if max_pages is None else max_pages, inf if max_products is None else max_products
    out, ends = [], {}
    for site in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == site), key=lambda r: (r[1], r[2], r[3]))
        listings = list(dict.fromkeys((r[1], r[2]) for r in own))
        n, got, reason, mine = 0, 0, "catalog_end", []
        for place in listings:
            seen, at, chain = set(), 0, [r for r in own if (r[1], r[2]) == place]
            while True:
                if n >= most:
                    reason = "max_pages"
                elif got >= room:
                    reason = "max_products"
                if reason != "catalog_end" or at == len(chain):
                    break
                _, _, listing, page, url, following, new = chain[at]
                seen.add(url)
                took = min(new, room - got)
                n, got, at = n + 1, got + took, at + 1
                mine.append([site, listing, page, took, None])
                if took < new or (got >= room and following is not None):
                    reason = "max_products"
                elif following is None:
                    break
                elif new == 0:
                    reason = "no_progress"
                elif following in seen:
                    reason = "repeated_page"
                if reason != "catalog_end":
                    break
            if reason != "catalog_end":
                break
        if mine:
            mine[-1][-1] = reason
        ends[site] = (site, n, got, reason, reason != "catalog_end")
        out += map(tuple, mine)
    return sorted(out), sorted(ends.values())


def invented(seed):
    of = random.Random(seed)
    rows = []
    for site in ("a", "b", "c", "d"):
        for place in range(of.randrange(1, 6)):
            length = 60 if site == "a" and place == 1 else of.randrange(1, 9)
            named = [f"u{of.randrange(40)}" for _ in range(length)]
            for page in range(length):
                following = named[page + 1] if page + 1 < length else None if of.random() < 0.8 else "not there"
                rows.append((site, place, f"l{place}", page + 1, named[page], following, 0 if of.random() < 0.04 else of.randrange(1, 6)))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [(None, None), (5, None), (None, 17), (12, 30), (0, 5), (5, 0), (1, 1)])
def test_walk(spark, seed, limits):
    rows = invented(seed)
    pages = spark.createDataFrame(rows, PAGES)
    walked = walks.walk(pages, *limits)
    want, ends = plain_walk(rows, *limits)
    assert sorted(tuple(r) for r in walked.select("site", "listing", "page", "products", "reason").collect()) == want
    got = walks.walk_results(pages.select("site").distinct(), walked, *limits)
    assert sorted(tuple(r) for r in got.collect()) == ends


def test_reasons_of_walks(spark):
    """A last page ends a listing before it can lack progress or use up the pages; a limited listing ends the site."""
    walk = lambda rows, *limits: [(r.listing, r.page, r.products, r.reason) for r in walks.walk(spark.createDataFrame([("s", *r) for r in rows], PAGES), *limits).orderBy("number").collect()]
    assert walk([(0, "A", 1, "u", None, 0)], 1) == [("A", 1, 0, "catalog_end")]
    assert walk([(0, "A", 1, "u", None, 3)], 1, 3) == [("A", 1, 3, "catalog_end")]
    assert walk([(0, "A", 1, "u", "v", 0), (0, "A", 2, "v", None, 1), (1, "B", 1, "w", None, 1)]) == [("A", 1, 0, "no_progress")]
    assert walk([(0, "A", 1, "u", None, 5), (1, "B", 1, "w", None, 5)], None, 7) == [("A", 1, 5, None), ("B", 1, 2, "max_products")]
    assert walk([(0, "A", 1, "u", None, 5), (1, "B", 1, "w", None, 5)], 1, 5) == [("A", 1, 5, "max_pages")]
    assert walk([(0, "A", 1, "u", "u", 5)]) == [("A", 1, 5, "repeated_page")]


def test_running_totals_of_one_hot_group(spark):
    """All rows but a few are one group; its ranges are several, and sums go on from one to the next."""
    rows = [("hot", i * 7 % 5003, i % 5) for i in range(5003)] + [(None, 2, 1), (None, 1, 4), ("x", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.o): (r.number, r.before_v) for r in ordered.running_totals(df, "g", ["o"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, before = {}, 0
    for n, (g, o, v) in enumerate(sorted(r for r in rows if r[0] == "hot"), 1):
        want[g, o] = (n, before)
        before += v
    assert got == want | {(None, 1): (1, 0), (None, 2): (2, 4), ("x", 1): (1, 0)}


def test_previous_rows_of_one_hot_group(spark):
    rows = [("hot", i * 7 % 3001, None if i % 10 == 3 else f"v{i}") for i in range(3001)] + [("x", 1, "a"), (None, 2, "c"), (None, 1, "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.o): (r.is_first, r.previous) for r in ordered.previous(spark.createDataFrame(rows, "g string, o int, v string").repartition(8), "g", ["o"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = sorted(r for r in rows if r[0] == "hot")
    want = {(g, o): (i == 0, hot[i - 1][2] if i else None) for i, (g, o, _) in enumerate(hot)}
    assert got == want | {("x", 1): (True, None), (None, 1): (True, None), (None, 2): (False, "b")}


def plain_sitemaps(seeds, stored, limit):
    import re
    from urllib.parse import urljoin

    queue, visited, first, documents = list(seeds), [], {}, []
    while queue and len(visited) < limit:
        url = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        status, body = stored.get(url, (404, ""))
        if not 200 <= status <= 299 or not re.search("<(?:urlset|sitemapindex)\\b", body, re.I):
            continue
        for loc in dict.fromkeys(urljoin(url, x.strip().replace("&amp;", "&")) for x in re.findall("(?is)<loc>(.*?)</loc>", body)):
            if not loc.startswith("https://s.example/") or "/no/" in loc:
                continue
            if "/p/" in loc:
                first.setdefault(loc, len(visited))
            elif ".xml" in loc and loc not in visited:
                queue.append(loc)
        documents.append((url, len(visited), len(first)))
    return sorted(documents), sorted(first.items())


@pytest.mark.parametrize("limit", [0, 1, 3, 9, 100])
def test_sitemap_walk(spark, limit):
    of = random.Random(7)
    names = [f"https://s.example/{i}.xml" for i in range(25)]
    links = lambda: "".join(f"<loc> {of.choice([*names, '/3.xml', '/p/%d' % of.randrange(60), 'https://t.example/9.xml', '/no/p/1', '/text'])}</loc>" for _ in range(8))
    stored = {n: (of.choice([200, 200, 200, 404]), f"<{of.choice(['urlset', 'sitemapindex', 'html'])}>{links()}") for n in names[:22]} | {names[0]: (200, f"<sitemapindex>{links()}<loc>/5.xml</loc>")}
    rule = SiteRule("s", ("s.example",), product_patterns=("/p/",), exclude_patterns=("/no/",))
    seeds = [names[24], names[0], names[0], names[1]]
    documents, products = walks.sitemap_walk(spark.createDataFrame([(x, i) for i, x in enumerate(seeds)], "url string, place int"), spark.createDataFrame([(k, *v) for k, v in stored.items()], "url string, status int, body string"), rule, limit)
    want = plain_sitemaps(seeds, stored, limit)
    assert sorted(tuple(r) for r in documents.collect()) == want[0]
    assert sorted(tuple(r) for r in products.collect()) == want[1]


def test_references_are_decoded_once(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#38;lt;&#x26;#65;": "&lt;&#65;", "&#65;&#x1F600;&#233;": "A\U0001f600é", "&lt;&GT;&quot;&apos;&nbsp;.": "<>\"' .", "&#0;&#55296;&#9999999;&x;": "&#0;&#55296;&#9999999;&x;", "": "", "&amp;amp;": "&amp;"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", text.decode_entities(F.col("t")).alias("d")).collect()} == cases


def plain_series(rows, max_items):
    pages, items = [], []
    for name in sorted({r[0] for r in rows}):
        own = {}
        for _, page, attempt, blank, keys in sorted(r for r in rows if r[0] == name and r[2] <= 2):
            if page not in own or own[page][0] and not blank:
                own[page] = (blank, [] if blank else [k for k in keys or [] if k is not None])
        first = page = min(own)
        got = []
        while page in own:
            blank, keys = own[page]
            fresh = [k for k in dict.fromkeys(keys) if k not in got]
            if page > first and (blank or not keys or not fresh or max_items is not None and len(got) >= max_items):
                break
            took = fresh if max_items is None else fresh[: max_items - len(got)]
            got += took
            pages.append((name, page, len(keys), len(fresh), len(got)))
            items += [(name, page, k) for k in took]
            page += 1
    return sorted(pages), sorted(items)


@pytest.mark.parametrize("max_items", [None, 1, 9])
def test_series(spark, max_items):
    of = random.Random(11)
    rows = []
    for s in range(30):
        for page in range(1, of.randrange(2, 9)):
            if of.random() < 0.08 and page > 1:
                continue
            blank = of.random() < 0.15
            rows.append((f"s{s}", page, 1, blank, None if blank else [None if of.random() < 0.1 else f"k{of.randrange(25)}" for _ in range(of.randrange(5))]))
            if blank:
                again = of.random() < 0.3
                rows.append((f"s{s}", page, 2, again, None if again else [f"k{of.randrange(40)}", f"k{of.randrange(40)}"]))
                rows.append((f"s{s}", page, 3, False, ["late"]))
    pages, items = walks.series(spark.createDataFrame(rows, "series string, page int, attempt int, blank boolean, keys array<string>"), max_items)
    want = plain_series(rows, max_items)
    assert sorted(tuple(r) for r in pages.collect()) == want[0]
    assert sorted((r.series, r.page, r.key) for r in items.collect()) == want[1]


def test_full_listings(spark):
    df = spark.createDataFrame([("https://a.example/b", 7), ("https://a.example/b?x=1&paginacion=24#y", 437), ("https://a.example/b?x=1", None)], "u string, n int")
    assert [r.x for r in df.select(walks.full_listing(F.col("u"), F.col("n"), "paginacion").alias("x")).collect()] == ["https://a.example/b?paginacion=7", "https://a.example/b?x=1&paginacion=437#y", "https://a.example/b?x=1"]
