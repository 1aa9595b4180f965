"""Queries over pages that are written from the parts of the test tables, each with SQL for the same records.

The SQL says what a record has to hold without reading any page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price, urls
from ..operators import audit, crawl, dedupe, inventory, quality
from ..operators.rules import RuleBook, SiteRule
from ..schema import ORDER, conform
from ..shared import spread
from ..sources import compatibility, profiles
from .catalog import PRODUCTS, QUERIES, SQL, products, query, table

__all__ = ["QUERIES", "SQL"]

CARDS_A_PAGE = 20


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.floor(F.round(F.col("p_retailprice") * 100) / 100).cast("bigint").cast("string").alias("amount"))


def _text(template: str) -> Column:
    """Columns in braces, other text as it is."""
    pieces = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(template.replace("}", "{").split("{"))]
    return F.concat(*pieces)


def _listings(parts: DataFrame, card: Column) -> DataFrame:
    """(url, html): cards in order, so many a page."""
    shown = parts.select(F.expr(f"k div {CARDS_A_PAGE}").alias("n"), F.struct("k", card.alias("card")).alias("c"))
    pages = spread(shown, "n").groupBy("n").agg(F.array_sort(F.collect_list("c")).alias("cards"))
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    return pages.select(F.concat(F.lit("https://www.s.example/list/"), F.col("n").cast("string")).alias("url"), F.concat(F.lit("<html><body><nav><a href='/'>Inicio</a></nav>"), body, F.lit("</body></html>")).alias("html"))


STATE = "CASE p_partkey % 3 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' END"
WHOLE = "(round(p_retailprice * 100)::BIGINT // 100)::VARCHAR"


def _state() -> Column:
    return F.when(F.col("k") % 3 == 0, "Agregar al carrito").when(F.col("k") % 3 == 1, "Agotado").otherwise("")


@query(f"SELECT 'https://www.s.example/product/' || p_partkey AS source_url, p_name AS product_name, {WHOLE} AS price, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'UYU' END AS currency, p_type AS description, {STATE} AS availability, 'https://www.s.example/i/' || p_partkey || '.jpg' AS image_url FROM part WHERE p_partkey % 7 <> 0")
def info_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumns({"state": _state(), "sign": F.when(F.col("k") % 2 == 0, "US$").otherwise("$U"), "mark": F.when(F.col("k") % 7 == 0, "product-category").otherwise("product")})
    card = '<div class="product-item-container"><a href="/{mark}/{k}?utm_source=m"><h3 class="product-info-title">{name} Código {k}</h3></a><div class="product-info-price">{sign} {amount}</div><p>{kind}</p><img src="/i/{k}.jpg"><b>{state}</b></div>'
    found = profiles.extract("info_cards", _listings(parts, _text(card)))
    return found.select("source_url", "product_name", "price", "currency", "description", "availability", "image_url")


@query(f"""SELECT 'https://www.s.example/catalogo/a/' || p_partkey AS source_url, p_name AS product_name, CASE WHEN p_partkey % 5 <> 0 THEN {WHOLE} END AS price, split_part(p_brand, '#', 1) || '#' || split_part(p_brand, '#', 2) AS brand, 'X' || (100000 + p_partkey) AS sku,
  CASE WHEN p_partkey % 4 = 0 THEN 'out_of_stock' WHEN p_partkey % 3 = 0 THEN 'in_stock' WHEN p_partkey % 3 = 1 THEN 'out_of_stock' END AS availability FROM part""")
def stock_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumns({"state": _state(), "gone": F.when(F.col("k") % 4 == 0, " prod_sin_stock").otherwise(""), "code": (F.col("k") + 100000).cast("string"), "cost": F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit('<span id="precio_ent_actual">'), "amount", F.lit("</span>")))})
    card = '<article class="prod_item{gone}"><a href="/catalogo/a/{k}"><span itemprop="name">{name}</span></a>{cost}<div class="copete_f">{brand} - {kind}</div><i class="sku">SKU: x{code}</i><b class="opcionescarrito">{state}</b></article>'
    return profiles.extract("stock_articles", _listings(parts, _text(card))).select("source_url", "product_name", "price", "brand", "sku", "availability")


@query(f"SELECT 'https://www.s.example/p/' || p_partkey AS source_url, p_name AS product_name, {WHOLE} AS price, p_brand || ',' || 'Otra' AS brands FROM part WHERE p_partkey % 6 <> 0")
def article_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumn("title", F.when(F.col("k") % 6 == 0, "Ver modelos").otherwise(F.col("name")))
    card = '<article class="card__producto--item"><h3><a href="/p/{k}">{title}</a></h3><div class="card__producto--item--info--titulo--modelos--linea--marcas"><h5>{brand}</h5><h5>Otra</h5><h5>{brand}</h5></div><div class="card__producto--item--info--tools--pie"><h4>$ {amount}</h4></div></article>'
    found = profiles.extract("article_cards", _listings(parts, _text(card)))
    return found.select("source_url", "product_name", "price", F.array_join("compatible_brands", ",").alias("brands"))


@query(f"SELECT 'https://www.s.example/p/' || p_partkey AS source_url, p_name AS product_name, {WHOLE} AS price FROM part")
def anchored_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = '<section><div><div><div><a href="/p/{k}">{name}</a></div></div><span>$ {amount}</span></div></section>'
    return profiles.anchored_records(_listings(_parts(spark, sf_dir), _text(card)), "/p/").select("source_url", "product_name", "price")


@query(f"""SELECT 'https://www.s.example/product/' || p_partkey AS url, p_name AS product_name, {WHOLE} AS price, p_brand AS brand, p_type AS description, {STATE} AS availability, 'https://www.s.example/f/' || p_partkey || '.png' AS image_url FROM part WHERE p_partkey % 8 <> 0""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumns({"state": _state(), "note": F.when(F.col("k") % 8 == 0, "Página no encontrada").otherwise("Envíos")})
    page = '<html><body><h1 class="product_title">{name}</h1><div class="product-info-price"><span class="price-number">$ {amount}</span></div><div class="brand">{brand}</div><div id="tab-description">{kind}</div><figure><img src="/f/{k}.png"></figure><form><button>{state}</button></form><footer>{note}</footer></body></html>'
    pages = parts.select(F.concat(F.lit("https://www.s.example/product/"), F.col("k").cast("string")).alias("url"), _text(page).alias("html"))
    return profiles.extract_pages("info_cards", pages).select("url", "product_name", "price", "brand", "description", "availability", "image_url")


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' - ' || p_name || ' - ' || p_type WHEN p_partkey % 3 = 1 THEN p_brand || ' - ' || p_name || '|' || p_brand || ' - Otro' END AS vehicles, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS brands,
  CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || '|Otro' END AS models, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS versions FROM part""")
def compatibility_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "<table><tr><th>x</th></tr><tr><td data-label='Marca'>{brand}</td><td data-label='Modelo'>{name}</td><td data-label='Motor / Año'>{kind}</td></tr></table>"
    lines = "<div class='item-texto'><p>Marca: {brand}</p><p>Modelos: {name}; Otro, buscar</p></div>"
    page = F.when(F.col("k") % 3 == 0, _text(rows)).when(F.col("k") % 3 == 1, _text(lines)).otherwise("<p>Nada</p>")
    found = compatibility.compatibility(_parts(spark, sf_dir).select("k", page.alias("html")))
    return found.select("k", *(F.array_join(c, "|").alias(c.removeprefix("compatible_")) for c in compatibility.LISTS))


@query("""WITH n AS (SELECT o_custkey AS listing, count(*) AS pages FROM orders GROUP BY 1), p AS (SELECT listing, pages, unnest(range(1, pages + 1)) AS page FROM n)
SELECT 'https://l.example/' || listing || '?page=' || page AS url, page::INT AS current_page, CASE WHEN page < pages THEN 'https://l.example/' || listing || '?page=' || (page + 1) END AS next_url, 'https://l.example/' || listing || '?page=' || pages AS last_url FROM p""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("listing")).agg(F.count("*").alias("pages"))
    link = lambda n, label: F.concat(F.lit('<a data-ci-pagination-page="'), n.cast("string"), F.lit('" href="?page='), n.cast("string"), F.lit('">'), label, F.lit("</a>"))
    links = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.col("pages")), lambda n: link(n, n.cast("string"))), ""), link(F.col("pages"), F.lit("»")), F.lit("</ul>"))
    # A listing's links are the same on all of its pages: they are made before these are.
    shown = spread(counted, "listing").select("*", links.alias("links")).select("listing", "links", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    page = F.concat(F.lit('<ul class="pagination"><li class="active"><span>'), F.col("page").cast("string"), F.lit("</span></li>"), F.col("links"))
    return crawl.page_summary(shown.select(F.concat(F.lit("https://l.example/"), F.col("listing").cast("string"), F.lit("?page="), F.col("page").cast("string")).alias("url"), page.alias("html")))


DOTTED_SQL = "CASE p_partkey % 6 WHEN 0 THEN whole WHEN 1 THEN whole || '.' || cent WHEN 2 THEN CASE WHEN length(whole) > 3 THEN grouped || '.' || cent ELSE whole || '.' || cent END WHEN 3 THEN whole || '.' || cent WHEN 4 THEN whole || '.' || cent END"


@query(f"""WITH p AS (SELECT *, (cents // 100)::VARCHAR AS whole, lpad((cents % 100)::VARCHAR, 2, '0') AS cent, (cents // 100000) || ',' || lpad((cents // 100 % 1000)::VARCHAR, 3, '0') AS grouped FROM (SELECT *, round(p_retailprice * 100)::BIGINT AS cents FROM part))
SELECT p_partkey AS id, {DOTTED_SQL} AS dotted, CASE WHEN p_partkey % 6 = 2 AND length(whole) > 3 THEN replace(grouped, ',', '.') || '.' || cent ELSE {DOTTED_SQL} END AS portal FROM p""")
def site_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", price.dotted_price(F.col("price")).alias("dotted"), price.portal_price(F.col("price")).alias("portal"))


_EVENTS = """e AS (SELECT event_id AS ord, event_type AS site, CASE WHEN event_id % 5 > 0 THEN 'https://e.example/' || (user_id % 50) END AS url, CASE WHEN event_id % 3 > 0 THEN 'k' || (event_id % 97) END AS sku FROM events),
filed AS (SELECT site, sku, arg_min(url, ord) AS url, min(ord) AS since FROM e WHERE sku IS NOT NULL AND url IS NOT NULL GROUP BY ALL),
named AS (SELECT e.ord, e.site, CASE WHEN e.ord >= f.since THEN f.url ELSE e.url END AS source_url, e.sku FROM e LEFT JOIN filed f ON f.site = e.site AND f.sku = e.sku)"""


def _two_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias(ORDER), F.col("event_type").alias("site"), F.when(k % 5 > 0, F.concat(F.lit("https://e.example/"), (F.col("user_id") % 50).cast("string"))).alias("source_url"), F.when(k % 3 > 0, F.concat(F.lit("k"), (k % 97).cast("string"))).alias("sku"), k.cast("string").alias("price"))
    return dedupe.merge_two_keys(conform(rows), "site")


@query(f"WITH {_EVENTS} SELECT site, source_url, min(ord) AS first, arg_max(sku, ord) FILTER (sku IS NOT NULL) AS sku, max(ord)::VARCHAR AS price FROM named WHERE source_url IS NOT NULL GROUP BY ALL")
def two_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_keys(spark, sf_dir)[0].select("site", "source_url", F.col(ORDER).alias("first"), "sku", "price")


@query(f"WITH {_EVENTS} SELECT site, count(*) AS n_records, count(*) - count(DISTINCT source_url) AS n_duplicates FROM named WHERE source_url IS NOT NULL GROUP BY site")
def two_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_keys(spark, sf_dir)[1]


_KEYED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'https://shop.example/p/' || (p_partkey % 1000) ELSE 'sku:' || (p_partkey // 2) END AS key FROM part"


def _normalized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://Shop.example:443/p/"), (k % 1000).cast("string"), F.lit("?utm_source=m&fbclid=1#top")))
    return dedupe.normalize_catalog(products(spark, sf_dir).withColumns({"source_url": url, "description": k.cast("string")}).drop("id"), "UYU")


@query(f"SELECT min(id) AS first, max(id)::VARCHAR AS description, CASE WHEN key LIKE 'https%' THEN key END AS source_url, 'UYU' AS currency FROM ({_KEYED}) GROUP BY key")
def normalized_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir)[0].select(F.col(ORDER).alias("first"), "description", "source_url", "currency")


@query(f"SELECT CASE WHEN key LIKE 'https%' THEN 'canonical_url' ELSE 'sku' END AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM ({_KEYED})) WHERE n > 1 GROUP BY 1")
def catalog_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT page_id, 'https://' || lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) || regexp_extract(regexp_replace(url, '^https?://', ''), '(/[^?#]*)', 1) || '?color=rojo' AS fetched FROM pages""")
def catalog_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("HTTPS://"), F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1)), F.lit(":443"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), F.lit("?utm_source=x&color=rojo&gclid=7&mc_eid=2#detalle"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(urls.catalog_url(marked), "^HTTPS", "https").alias("fetched"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'USD' WHEN 3 THEN 'UYU' WHEN 4 THEN 'UYU' ELSE 'ARS' END AS currency FROM events")
def currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, amount = F.col("event_id") % 6, F.col("value").cast("string")
    text = F.when(k == 1, F.concat(F.lit("US$ "), amount)).when(k == 2, F.concat(amount, F.lit(" usd"))).when(k == 3, F.concat(F.lit("$U "), amount)).when(k == 4, F.concat(F.lit("$ "), amount)).otherwise(amount)
    return table(spark, sf_dir, "events").select("event_id", price.infer_currency(F.when(k == 0, " eur "), text, F.lit("ARS")).alias("currency"))


STRICT = SiteRule("shop", ("shop0.example", "shop1.example", "shop2.example"), "Shop", product_patterns=("/producto/",), keep_out_of_stock=False, strict_paths=True)


@query(f"""WITH {PRODUCTS} SELECT id, CASE WHEN price IS NULL THEN 'missing_price,' ELSE '' END || CASE WHEN source_url IS NULL THEN 'missing_url,' ELSE '' END || CASE WHEN length(description) > 1200 THEN 'noisy_description,' ELSE '' END || CASE WHEN price IS NULL OR source_url IS NULL OR coalesce(availability, '') NOT IN ('in_stock', 'disponible') THEN 'not_sellable' ELSE '' END AS warnings
FROM products WHERE (id % 4 = 0 OR id % 4 = 3) AND coalesce(availability, '') NOT IN ('Out of Stock', 'agotado')""")
def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Categories say what the parts are for, so that only the rule decides.
    rows = products(spark, sf_dir).withColumn("category", F.lit("repuestos de motor"))
    mark = lambda w: F.when(F.array_contains("quality_warnings", w), w).otherwise("")
    joined = F.concat(*(F.concat(mark(w), F.when(mark(w) != "", ",").otherwise("")) for w in ("missing_price", "missing_url", "noisy_description")), mark("not_sellable"))
    return quality.gate(rows, STRICT).select("id", joined.alias("warnings"))


@query(f"WITH {PRODUCTS} SELECT id, product_name FROM products WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND host = 'shop1.example'")
def vehicle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a brand's links, of the sites that a rule's label means."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("inventory_id"), F.when(F.col("l_quantity") > 45, "volkswagen").otherwise("fiat").alias("brand_id"))
    rules = RuleBook((SiteRule("second", ("shop1.example",), "The Second Shop"),))
    return inventory.apply_filters(products(spark, sf_dir), inventory.Filters(site="the second shop", vehicle_brand="V.W."), links, rules).select("id", "product_name")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'detail' ELSE 'listing' END AS product_name, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN '9' ELSE '5' END AS price, CASE WHEN o_orderkey % 4 = 0 THEN 'a,B,c' ELSE 'a,b' END AS brands FROM orders""")
def overlaid_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://o.example/"), k.cast("string")).alias("source_url")
    orders = table(spark, sf_dir, "orders")
    listing = orders.select(k.alias("k"), url, F.lit("listing").alias("product_name"), F.lit("5").alias("price"), F.array(F.lit("a"), F.lit("b")).alias("compatible_brands"))
    detail = orders.where(k % 4 == 0).select(url, F.lit("detail").alias("product_name"), F.when(k % 3 == 0, "9").alias("price"), F.array(F.lit("B"), F.lit("c")).alias("compatible_brands"))
    return inventory.overlay(listing, detail, "source_url").select("k", "product_name", "price", F.array_join("compatible_brands", ",").alias("brands"))


@query("""WITH s AS (SELECT o_custkey AS site, 100.0 * count(*) FILTER (o_orderstatus <> 'P') / count(*) AS coverage, count(*) FILTER (o_orderpriority = '1-URGENT') // 6 AS failures, count(*) FILTER (o_orderpriority = '2-HIGH') // 6 AS errors, count(*) FILTER (o_orderpriority = '3-MEDIUM') // 6 AS rejected,
  count(*) FILTER (o_orderpriority = '5-LOW') // 4 AS no_price, count(*) FILTER (o_totalprice > 300000) // 2 AS no_sku, count(*) FILTER (o_totalprice < 20000) // 2 AS no_image FROM orders GROUP BY 1)
SELECT site, CASE WHEN coverage < 70 OR failures > 0 OR errors > 0 OR rejected > 0 THEN 'CRITICAL' WHEN coverage < 95 OR no_price > 0 OR no_sku > 0 OR no_image > 0 THEN 'REVIEW' ELSE 'OK' END AS status FROM s""")
def site_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda test, n: F.expr(f"count_if({test}) div {n}")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site")).agg(
        (100.0 * F.count_if(F.col("o_orderstatus") != "P") / F.count("*")).alias("coverage"), share("o_orderpriority = '1-URGENT'", 6).alias("failures"), share("o_orderpriority = '2-HIGH'", 6).alias("errors"), share("o_orderpriority = '3-MEDIUM'", 6).alias("rejected"),
        share("o_orderpriority = '5-LOW'", 4).alias("no_price"), share("o_totalprice > 300000", 2).alias("no_sku"), share("o_totalprice < 20000", 2).alias("no_image"),
    )
    return s.select("site", audit.status(*(F.col(c) for c in ("coverage", "failures", "errors", "rejected", "no_price", "no_sku", "no_image"))).alias("status"))


@query("""WITH h AS (SELECT regexp_replace(split_part(replace(replace(lower(url), 'https://', ''), 'http://', ''), '/', 1), '^www\\.', '') AS host FROM pages) SELECT host, CASE WHEN length(host) % 2 = 0 THEN 'House of ' || host ELSE host END AS label, count(*) AS n FROM h GROUP BY 1""")
def labelled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("site", F.col("url"))
    hosts = pages.select(urls.inventory_host(F.col("site")).alias("host")).distinct().where(F.length("host") % 2 == 0)
    return inventory.site_stats(pages, hosts.withColumn("label", F.concat(F.lit("House of "), F.col("host"))))
