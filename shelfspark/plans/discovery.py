"""Queries of walks: budgets over a site's listings, and sitemaps. The SQL of walks goes page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import categories, refresh, walks
from ..operators.rules import SiteRule
from ..schema import ORDER
from ..shared import spread, write_table
from ..sources import embedded, json_trees, portal, rendered
from .catalog import _LINKS_SQL, PRODUCTS, QUERIES, SQL, _progress, products, query, table

__all__ = ["QUERIES", "SQL"]


def walk_sql(pages: str, max_pages: int, max_products: int, columns: str) -> str:
    """One page a step, with what the walk knows then; ``pages`` has site, place, page, url, next_url, fresh."""
    return f"""WITH RECURSIVE {pages},
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place, page) AS i, max(place) OVER (PARTITION BY site) AS last_place FROM pages),
starts AS (SELECT site, place, min(i) AS i FROM p GROUP BY site, place),
after AS (SELECT a.site, a.place, min(b.i) AS next_i FROM starts a JOIN starts b ON a.site = b.site AND b.place > a.place GROUP BY a.site, a.place),
stored AS (SELECT p.*, after.next_i AS next_listing, EXISTS (SELECT 1 FROM p q WHERE q.site = p.site AND q.place = p.place AND q.i = p.i + 1) AS has_more FROM p LEFT JOIN after ON after.site = p.site AND after.place = p.place),
walk AS (
  SELECT site, place, page, next_url, i, 1 AS number, fresh, 0::BIGINT AS before, [url] AS seen, last_place, next_listing, has_more FROM stored WHERE i = 1
  UNION ALL
  SELECT p.site, p.place, p.page, p.next_url, p.i, w.number + 1, p.fresh, w.before + w.fresh, CASE WHEN p.place = w.place THEN list_append(w.seen, p.url) ELSE [p.url] END, p.last_place, p.next_listing, p.has_more
  FROM walk w JOIN stored p ON p.site = w.site AND p.i = CASE WHEN w.next_url IS NULL OR NOT w.has_more THEN w.next_listing ELSE w.i + 1 END
  WHERE NOT (w.before + w.fresh > {max_products} OR w.before + w.fresh >= {max_products} OR w.number >= {max_pages} OR w.next_url IS NOT NULL AND (w.fresh = 0 OR list_contains(w.seen, w.next_url)))),
ended AS (
  SELECT *, least(fresh, {max_products} - before) AS products,
    CASE WHEN before + fresh > {max_products} OR before + fresh >= {max_products} AND next_url IS NOT NULL THEN 'max_products'
      WHEN next_url IS NULL AND place < last_place THEN CASE WHEN number >= {max_pages} THEN 'max_pages' WHEN before + fresh >= {max_products} THEN 'max_products' END
      WHEN next_url IS NULL THEN 'catalog_end'
      WHEN fresh = 0 THEN 'no_progress' WHEN list_contains(seen, next_url) THEN 'repeated_page' WHEN number >= {max_pages} THEN 'max_pages'
      WHEN NOT has_more AND place = last_place THEN 'catalog_end' END AS reason
  FROM walk)
SELECT {columns} FROM ended"""


@query(walk_sql(f"{_LINKS_SQL}, n AS (SELECT host AS site, page_id AS page, count(*) FILTER (fresh) AS fresh FROM seen GROUP BY host, page_id), pages AS (SELECT site, 0 AS place, page, page::VARCHAR AS url, lead(page::VARCHAR) OVER (PARTITION BY site ORDER BY page) AS next_url, fresh FROM n)", 6, 30, "site AS host, page AS page_id, (before + products)::BIGINT AS so_far, reason"))
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = _progress(spark, sf_dir)
    chain = Window.partitionBy("host").orderBy("page_id")
    address = F.col("page_id").cast("string")
    pages = progress.select(F.col("host").alias("site"), F.lit(0).alias("place"), F.col("host").alias("listing"), F.col("page_id").alias("page"), address.alias("url"), F.lead(address).over(chain).alias("next_url"), "new_in_listing")
    return walks.walk(pages, 6, 30).select(F.col("site").alias("host"), F.col("page").alias("page_id"), "so_far", "reason")


#: Events as pages: a user's events of a type are a listing, and a type's users in order are a site's listings.
EVENT_PAGES = """pages AS (
  SELECT event_type || (user_id % 20) AS site, user_id AS place, event_id AS page, 'u' || (event_id % 211) AS url,
    CASE WHEN event_id % 41 = 0 THEN 'gone' ELSE lead('u' || (event_id % 211)) OVER (PARTITION BY event_type, user_id ORDER BY event_id) END AS next_url,
    CASE WHEN (props->>'$.k')::BIGINT % 37 = 5 THEN 0 ELSE (props->>'$.k')::BIGINT % 4 + 1 END AS fresh
  FROM events)"""
BUDGET = (25, 60)


def _event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, address = F.get_json_object("props", "$.k").cast("bigint"), F.concat(F.lit("u"), (F.col("event_id") % 211).cast("string"))
    chain = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("site"), F.col("user_id").alias("place"), F.col("user_id").alias("listing"), F.col("event_id").alias("page"), address.alias("url"),
        F.when(F.col("event_id") % 41 == 0, "gone").otherwise(F.lead(address).over(chain)).alias("next_url"), F.when(k % 37 == 5, 0).otherwise(k % 4 + 1).alias("new_in_listing"),
    )


@query(walk_sql(EVENT_PAGES, *BUDGET, "site, place AS listing, page, number::BIGINT AS number, products::BIGINT AS products, (before + products)::BIGINT AS so_far, reason"))
def site_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.walk(_event_pages(spark, sf_dir), *BUDGET).select("site", "listing", "page", F.col("number").cast("bigint").alias("number"), F.col("products").cast("bigint").alias("products"), "so_far", "reason")


@query(walk_sql(EVENT_PAGES, *BUDGET, "site, count(*)::BIGINT AS pages, sum(products)::BIGINT AS products, max(reason) AS reason, max(reason) <> 'catalog_end' AS limited") + " GROUP BY site")
def site_walk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _event_pages(spark, sf_dir)
    return walks.walk_results(pages.select("site").distinct(), walks.walk(pages, *BUDGET), *BUDGET)


SHOP = SiteRule("shop", ("shop.example",), product_patterns=("/product/",), exclude_patterns=("/product/[0-9]*13$",))
SITEMAP_LIMIT = 20


@query(f"""WITH docs AS (
  SELECT 3 AS number, 'https://shop.example/sitemap.xml' AS url, NULL::INTEGER AS region, NULL::INTEGER AS nation
  UNION ALL SELECT 4 + (SELECT count(*) FROM region o WHERE o.r_regionkey < r.r_regionkey), 'https://shop.example/region' || r_regionkey || '.xml', r_regionkey, NULL FROM region r
  UNION ALL SELECT 4 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation o WHERE (o.n_regionkey, o.n_nationkey) < (n.n_regionkey, n.n_nationkey)), 'https://www.shop.example/nation' || n_nationkey || '.xml?x=1&y=2', NULL, n_nationkey FROM nation n),
visited AS (SELECT * FROM docs WHERE number <= {SITEMAP_LIMIT} AND (nation IS NULL OR nation % 7 <> 3 AND nation % 11 <> 5)),
found AS (SELECT 'https://shop.example/product/' || (c_custkey // 2) AS url, min(number) AS number FROM visited JOIN customer ON c_nationkey = nation WHERE NOT regexp_matches((c_custkey // 2)::VARCHAR, '13$') GROUP BY 1)
SELECT 'product' AS kind, url, number::BIGINT AS number, NULL::BIGINT AS product_count FROM found
UNION ALL SELECT 'document', url, number, (SELECT count(*) FROM found f WHERE f.number <= v.number) FROM visited v""")
def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of regions, whose sitemaps name nations (some of which fail or are not there), and these customers' products."""
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    text = lambda *parts: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts))
    loc = lambda *parts: text("<loc> ", *parts, " </loc>")

    def listed(rows: DataFrame, kind: str) -> DataFrame:
        """(url, status, body) of rows (url, status, n, loc): a sitemap's addresses in order."""
        locs = rows.groupBy("url", "status").agg(F.array_sort(F.collect_list(F.struct("n", "loc"))).alias("locs"))
        return locs.select("url", "status", text(f"<{kind}>", F.array_join(F.transform("locs", lambda x: x["loc"]), "\n"), f"</{kind}>").alias("body"))

    r, n, c = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    root = listed(region.select(F.lit("https://shop.example/sitemap.xml").alias("url"), F.lit(200).alias("status"), r.alias("n"), loc("/region", r, ".xml").alias("loc")), "sitemapindex")
    regions = listed(nation.select(text("https://shop.example/region", F.col("n_regionkey"), ".xml").alias("url"), F.lit(200).alias("status"), n.alias("n"), text(loc("https://www.shop.example/nation", n, ".xml?x=1&amp;y=2"), loc("/sitemap.xml"), loc("https://other.example/a.xml")).alias("loc")), "sitemapindex")
    nation_url = text("https://www.shop.example/nation", F.col("c_nationkey"), ".xml?x=1&y=2").alias("url")
    of_nation = customer.where("c_nationkey % 11 <> 5").select(nation_url, F.when(F.col("c_nationkey") % 7 == 3, 500).otherwise(200).alias("status"), c.alias("n"), text(loc("https://shop.example/product/", F.expr("c_custkey div 2")), loc("https://other.example/product/1")).alias("loc"))
    sitemaps = root.unionAll(regions).unionAll(listed(of_nation, "urlset"))
    seeds = spark.range(1).select(F.posexplode(walks.sitemap_seeds(F.lit("https://shop.example/x"))).alias("place", "url"))
    documents, products = walks.sitemap_walk(seeds, sitemaps, SHOP, SITEMAP_LIMIT)
    return products.select(F.lit("product").alias("kind"), "url", "number", F.lit(None).cast("bigint").alias("product_count")).unionAll(documents.select(F.lit("document"), "url", "number", "product_count"))


@query("""WITH p AS (SELECT p_partkey AS k, 'P' || p_partkey AS code, p_partkey % 5 <> 0 AS usable, p_partkey % 7 = 0 AS pictured, p_partkey % 3 <> 0 AS varied, p_name, p_brand, p_type FROM part)
SELECT 'https://s.example/p/' || k AS url, code AS sku, CASE WHEN usable THEN p_name END AS product_name, (CASE WHEN usable AND pictured AND NOT varied THEN k % 100 ELSE 1000 + k % 100 END)::VARCHAR AS price, 'USD' AS currency, p_type AS category, CASE WHEN usable THEN p_brand END AS brand,
  CASE WHEN k % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
  concat_ws(',', CASE WHEN k % 4 = 1 THEN 'https://s.example/m/' || k || '.png' END, CASE WHEN varied THEN 'https://cdn.example/v/' || k || '.jpg' END, CASE WHEN usable AND pictured THEN 'https://s.example/a/' || k || '.png' END, 'https://s.example/p/g' || k || '.gif', 'https://s.example/g/' || k || '-1.webp') AS images
FROM p""")
def embedded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two objects, in either order, of which sometimes one is another product's, and galleries beside those of other products."""
    k = F.col("p_partkey")
    name = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    code = name("P", k)
    one = F.to_json(F.struct(F.struct(F.when(k % 5 == 0, "X").otherwise(code).alias("codigo"), F.col("p_name").alias("nombre"), F.col("p_brand").alias("marca"), F.when(k % 7 == 0, name("/a/", k, ".png")).alias("img")).alias("producto"), (k % 100).alias("precioMonto")))
    other = F.to_json(F.struct(F.struct(code.alias("codigo"), F.col("p_type").alias("categoria")).alias("producto"), F.when(k % 3 != 0, F.struct(code.alias("codigo"), name("//cdn.example/v/", k, ".jpg").alias("img"))).alias("variantes"), (1000 + k % 100).alias("precioMonto"), F.struct(F.lit("USD").alias("cod")).alias("moneda"), (k % 2 == 0).alias("tieneStock")))
    script = lambda x: name("<script>var p = {a: 1}; show(", x, ");</script>")
    meta = F.when(k % 4 == 1, name('<meta property="og:image" content="/m/', k, '.png">')).otherwise(F.lit('<meta property="og:image" content="/m/logo.png">'))
    gallery = name('<div class="galeriaProducto"><img src="/g/', k, '-1.webp"><img data-src="g', k, '.gif"><img src="/banner.jpg"></div><section class="productosRelacionados"><div class="imagenes"><img src="/other/', k, '.jpg"></div></section>')
    first, second = F.when(k % 2 == 0, script(one)).otherwise(script(other)), F.when(k % 2 == 0, script(other)).otherwise(script(one))
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select(name("https://s.example/p/", k).alias("url"), code.alias("code"), F.concat(meta, first, gallery, second).alias("html"))
    return embedded.embedded_records(pages, F.col("code")).select("url", "sku", "product_name", "price", "currency", "category", "brand", "availability", F.array_join("image_urls", ",").alias("images"))


@query("""WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS key, NULL AS parent, r_name AS label FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 5 THEN 'c' || (c_custkey + 1) WHEN c_custkey % 97 = 6 THEN 'c' || (c_custkey - 1) WHEN c_custkey % 6 = 0 THEN 'n' || c_nationkey WHEN c_custkey % 101 = 1 THEN 'missing' ELSE 'c' || (c_custkey - 1) END, c_mktsegment FROM customer),
tree AS (
  SELECT key, 0 AS depth, label AS path FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT key FROM nodes)
  UNION ALL SELECT n.key, depth + 1, path || '/' || label FROM tree JOIN nodes n ON n.parent = tree.key)
SELECT key, depth, path FROM nodes LEFT JOIN tree USING (key)""")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and chains of customers as categories; some chains run in circles, some hang from what is not there."""
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    c = F.col("c_custkey")
    parent = F.when(c % 97 == 5, name("c", c + 1)).when(c % 97 == 6, name("c", c - 1)).when(c % 6 == 0, name("n", F.col("c_nationkey"))).when(c % 101 == 1, "missing").otherwise(name("c", c - 1))
    nodes = region.select(name("r", F.col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nodes = nodes.unionAll(nation.select(name("n", F.col("n_nationkey")), name("r", F.col("n_regionkey")), "n_name")).unionAll(customer.select(name("c", c), parent, "c_mktsegment"))
    return categories.tree(nodes).select("key", "depth", F.array_join("path", "/").alias("path"))


@query(f"""WITH {PRODUCTS}, s AS (SELECT id, image_url AS old, CASE WHEN id % 5 = 0 THEN NULL ELSE CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'https://img.example/placeholder.png' WHEN 2 THEN image_url ELSE 'https://img.example/n/' || id || '.jpg' END END AS new, id % 5 = 0 AS error FROM products WHERE id % 4 = 0),
j AS (SELECT *, coalesce(regexp_matches(old, 'logo|placeholder'), false) AS invalid, new IS NOT NULL AND NOT regexp_matches(new, 'logo|placeholder') AS valid, id % 7 = 2 AS same FROM s),
runs AS (SELECT *, n AS run, CASE WHEN n = 3 AND valid THEN false ELSE invalid END AS invalid_now, valid AND NOT same AND n < 3 AS would FROM j, (VALUES (1), (2), (3)) AS t(n))
SELECT run, count(*) AS total_candidates, count(*) FILTER (invalid_now) AS current_invalid, count(*) FILTER (valid) AS new_valid, count(*) FILTER (NOT valid AND NOT error) AS without_valid,
  count(*) FILTER (would) AS would_update, count(*) FILTER (would AND run = 2) AS updated, count(*) FILTER (error) AS errors FROM runs GROUP BY run""")
def image_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run, a run that is applied, and another one, which changes nothing."""
    stock = products(spark, sf_dir).drop(ORDER).withColumn("search_text", F.lit(""))
    k = F.col("id")
    image = F.when(k % 7 == 1, "https://img.example/placeholder.png").when(k % 7 == 2, F.col("image_url")).when(k % 7 != 0, F.concat(F.lit("https://img.example/n/"), k.cast("string"), F.lit(".jpg")))
    found = stock.where("id % 5 <> 0").select("source_url", image.alias("image_url"), F.when(~(k % 7).isin(0, 2), F.array(image)).alias("image_urls"))
    at, under = F.lit(2000).cast("bigint"), ("https://www.shop",)
    dry = refresh.backfill_images(stock, found, under, at)
    applied = write_table(refresh.backfill_images(stock, found, under, at, apply=True), "backfilled")
    again = refresh.backfill_images(applied.drop("reason", "changed", "previous_invalid", "new_valid"), found, under, at, apply=True)
    runs = [refresh.backfill_summary(x, i == 2).withColumn("run", F.lit(i)) for i, x in enumerate((dry, applied, again), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("""WITH p AS (SELECT p_partkey AS k, upper(p_name) AS title, upper(p_type) AS kind FROM part),
c AS (SELECT k, title, unnest([title, title || ' ' || (1990 + k % 30), CASE WHEN k % 3 = 0 THEN title || ' con rejilla corsa' ELSE 'Comprar' END, 'MARCA ' || title || ' X Y Z', kind || ' HB20 2001-2004']) AS name, unnest([0, 1, 2, 3, 4]) AS i FROM p),
s AS (SELECT k, name, i - CASE WHEN i > 2 AND k % 3 <> 0 THEN 1 ELSE 0 END AS place, lower(name) AS t, lower(title) AS b, i FROM c WHERE name <> 'Comprar'),
scored AS (SELECT k, name, place, 100 - place + CASE WHEN t = b THEN 30 ELSE 0 END + CASE WHEN length(t) > length(b) AND starts_with(t, b) THEN 140 ELSE 0 END + CASE WHEN length(t) > length(b) AND contains(t, b) THEN 90 ELSE 0 END
  + 8 * least(12, len(list_filter(string_split(t, ' '), lambda w: w <> '' AND NOT list_contains(string_split(b, ' '), w)))) + CASE WHEN i IN (1, 4) THEN 55 ELSE 0 END + CASE WHEN i = 2 THEN 45 + 35 ELSE 0 END + CASE WHEN i = 4 THEN 35 ELSE 0 END
  + CASE WHEN i <> 2 THEN 10 ELSE 0 END - CASE WHEN i = 3 THEN 200 ELSE 0 END AS score FROM s)
SELECT k, arg_max(name, (score, -place)) AS name FROM scored GROUP BY k""")
def best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, title = F.col("p_partkey"), F.upper("p_name")
    space = lambda *parts: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    texts = F.array(title, space(title, 1990 + k % 30), F.when(k % 3 == 0, space(title, "con rejilla corsa")).otherwise("Comprar"), space("MARCA", title, "X Y Z - Yokomitsu"), space(F.upper("p_type"), "HB20 2001-2004"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("k"), names.best_name(texts, title).alias("name"))


@query("""SELECT n_nationkey AS id, max(greatest(n, 7 + n_nationkey % 3))::BIGINT AS count, sum(n)::BIGINT AS members FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation) GROUP BY n_nationkey""")
def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations as nested JSON that announces how many there are, in texts and numbers."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("key")).alias("inner"))).alias("items"))
    items = F.coalesce("items", F.array().cast(own.schema["items"].dataType))
    body = F.to_json(F.struct(F.struct(F.concat(F.size(items).cast("string"), F.lit(" in all")).alias("totalRegistros"), F.struct((7 + F.col("n_nationkey") % 3).alias("recordsShown"), F.lit("none").alias("filtered")).alias("page")).alias("meta"), items.alias("items")))
    found = write_table(json_trees.entries(nation.join(own, "n_nationkey", "left").select("n_nationkey", body.alias("body")), "n_nationkey"), "json-entries")
    members = found.where("key = 'name'").groupBy("id").agg(F.count("*").alias("members"))
    return json_trees.announced_count(found).join(members, "id", "left").select("id", F.col("count").cast("bigint").alias("count"), F.coalesce("members", F.lit(0)).alias("members"))


@query("""WITH p AS (
  SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, event_id % 23 = 0 AND event_id % 46 <> 0 AS blank,
    CASE WHEN event_id % 31 = 7 THEN [] ELSE ['k' || ((props->>'$.k')::BIGINT % 30), 'u' || (event_id % 50), 'k' || ((props->>'$.k')::BIGINT % 30)] END AS keys FROM events),
f AS (SELECT series, page, blank, CASE WHEN blank THEN [] ELSE keys END AS keys FROM p),
firsts AS (SELECT series, key, min(page) AS page FROM (SELECT series, page, unnest(keys) AS key FROM f) GROUP BY series, key),
n AS (SELECT f.series, f.page, f.blank, len(f.keys) AS n, (SELECT count(*) FROM firsts x WHERE x.series = f.series AND x.page = f.page) AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY page) AS so_far FROM n),
e AS (SELECT series, min(page) AS last FROM r WHERE page > 1 AND (blank OR n = 0 OR new = 0 OR so_far - new >= 40) GROUP BY series)
SELECT series, page::INTEGER AS page, n::BIGINT AS n, new::BIGINT AS new, least(so_far, 40)::BIGINT AS so_far FROM r LEFT JOIN e USING (series) WHERE last IS NULL OR page < last""")
def series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pages of a series; some answers are empty, some of these not when asked again."""
    k = F.get_json_object("props", "$.k").cast("bigint") % 30
    e = table(spark, sf_dir, "events").withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    keys = F.when(F.col("event_id") % 31 == 7, F.array().cast("array<string>")).otherwise(F.array(name("k", k), name("u", F.col("event_id") % 50), name("k", k)))
    first = e.select(F.col("user_id").alias("series"), "page", F.lit(1).alias("attempt"), (F.col("event_id") % 23 == 0).alias("blank"), keys.alias("keys"))
    again = e.where("event_id % 23 = 0").select(F.col("user_id").alias("series"), "page", F.lit(2).alias("attempt"), (F.col("event_id") % 46 != 0).alias("blank"), keys.alias("keys"))
    return walks.series(first.unionAll(again), 40)[0]


@query("""SELECT 'https://p.example/list/' || (p_partkey // 20) AS page_url, 'https://p.example/v2/producto-detalle/m/' || p_partkey || '/x' AS source_url, CASE WHEN p_partkey % 2 = 0 THEN 'D' || p_partkey ELSE 'YK-' || p_partkey END AS sku,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(p_name) || ' ' || p_partkey END AS product_name, (floor(p_retailprice)::BIGINT)::VARCHAR AS price, CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'UYU' END AS currency, p_brand AS brand, p_type AS model,
  'https://p.example/i/' || p_partkey || '.jpg' AS image_url FROM part""")
def portal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of twenty cards, marked on even pages and known by their links alone on odd ones."""
    k = F.col("p_partkey")
    name = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    mark = F.when(k % 2 == 0, name(' data-codprod="D', k, '"')).otherwise(F.lit(' data-codprod=""'))
    title = F.when(k % 5 == 0, F.lit("<h3>Ver detalle</h3>")).otherwise(name("<h3>", F.upper("p_name"), " ", k, "</h3>"))
    amount = name('<p class="precio">', F.when(k % 3 == 0, "US$ ").otherwise("$ "), F.floor("p_retailprice").cast("bigint"), "</p>")
    card = name("<li", mark, '><a href="/v2/producto-detalle/m/', k, '/x"><img src="/i/', k, '.jpg"></a>', title, amount, "<p>SKU: YK-", k, " Marca: ", F.col("p_brand"), " Modelo: ", F.col("p_type"), "</p></li>")
    shown = table(spark, sf_dir, "part").select(F.expr("p_partkey div 20").alias("n"), F.struct(k, card.alias("card")).alias("c"))
    pages = spread(shown, "n").groupBy("n").agg(F.sort_array(F.collect_list("c")).alias("cards"))
    html = name("<html><body><nav><a href='/'>Inicio</a></nav><ul>", F.array_join(F.transform("cards", lambda c: c["card"]), ""), "</ul></body></html>")
    found = portal.listing_records(pages.select(name("https://p.example/list/", F.col("n")).alias("url"), html.alias("html")))
    return found.select("page_url", "source_url", "sku", F.when(~F.col("product_name").isin("X"), F.col("product_name")).alias("product_name"), "price", "currency", "brand", F.get("compatible_models", F.lit(0)).alias("model"), "image_url")


@query("""SELECT 'https://r.example/p/' || p_partkey AS source_url, p_name || ' n' || p_partkey AS product_name, (p_size * 7)::VARCHAR AS price, 'UYU' AS currency, p_brand AS marca, CASE WHEN p_partkey % 4 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM part
UNION ALL SELECT 'https://r.example/p/' || p_partkey || '/rel', p_type || ' m' || p_partkey, p_size::VARCHAR, 'USD', NULL, NULL FROM part""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a heading, an amount and a table, with the card of another product behind a link."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    state = F.when(k % 4 == 0, "Agotado").otherwise("En stock")
    whole = text("<main><h1>", F.col("p_name"), " n", k, "</h1><p>$ ", size * 7, "</p><table><tr><th>Marca</th><td>", F.col("p_brand"), "</td></tr></table><p>", state, "</p></main>")
    card = text('<div class="card"><a href="/p/', k, '/rel">', F.col("p_type"), " m", k, "</a> US$ ", size, "</div>")
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select(text("https://r.example/p/", k).alias("url"), text("<body>", whole, card, '<a href="/contacto">Contacto</a></body>').alias("html"))
    found = rendered.rendered_records(pages)
    return found.select("source_url", "product_name", "price", "currency", F.try_element_at("attributes", F.lit("Marca")).alias("marca"), "availability")
