"""Cards and details of a portal whose pages have no fixed shape: which element is a product's, and its record.

Cards are looked for in tiers: elements that are marked as products, then what surrounds links
to details, then broad elements that hold such a link. A detail is the marked element of the
least text. Where an element's text and links are is known from the walk over the page, so
that climbing and comparing containers reads no element twice.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, price, urls
from ..functions.text import clean_text, label_case, labelled_value
from ..operators.quality import availability
from .selectors import Boxes, Request, Walk, Ways, cards, find

# Selectors of each tier, what a product's text or links hold, labels, and the longest text of a card.
MARKED = ("[data-codprod]", "[data-product]", "article.producto", "article.product", ".product-item", ".item-product")
BROAD = (".producto", ".product", "article", "tr", "li")
DETAILS = ("[data-codprod]", ".producto-detalle", ".detalle-producto", ".product-detail", ".single-product", "#producto-detalle", "#product-detail", "main article", "article")
LINK = "a[href*=producto-detalle]"
LIKE = re.compile(r"producto-detalle|cod\.?\s*yokomitsu|c[oó]digo|sku|oem|precio|\$\s*\d", re.I)
LONGEST = 3_000
SKU = "C[oó]d\\. Yokomitsu|C[oó]digo Yokomitsu|SKU|C[oó]digo"
LABELS = {"referencia": "OEM|Referencia|Ref", "marca": "Marca", "marca_vehiculo": "(?:Marca Veh[ií]culo|Veh[ií]culo Marca)", "modelo": "Modelo(?: Veh[ií]culo)?", "llegada": "Pr[oó]xima llegada", "procedencia": "Procedencia", "categoria": "Categor[ií]a|Rubro", "producto": "Producto|Descripci[oó]n"}
PRICED = "(?i)((?:US\\$|\\$U|\\$|UYU|USD)\\s*[0-9][0-9.,]*(?:\\s*\\+?\\s*IVA)?)"

TITLES = (".product-title", ".producto-titulo", ".nombre", ".name", ".descripcion", "h1", "h2", "h3", "h4", "a[href*=producto-detalle]", "a[href*=producto]")
PARTS: dict[str, Ways] = {
    "link": [(LINK, "href"), ("a[href*=producto]", "href"), ("a[href]", "href")],
    "title": [(s, "text") for s in TITLES],
    "code": [("[data-codprod]", "data-codprod")],
    "price_text": [(".price", "text"), (".precio", "text"), ("[class*=price]", "text"), ("[class*=precio]", "text")],
    "image": [("img[data-src]", "data-src"), ("img[src]", "src")],
}
#: Where a detail's names are, in turn; then small texts; then the head.
NAMED: Ways = [
    *((f"{a} {b}", "leaves") for a, b in ((".producto-detalle", ".nombre"), (".producto-detalle", ".name"), (".producto-detalle", ".descripcion"), (".product-detail", ".name"), (".product-detail", ".description"), (".detalle-producto", ".nombre"), (".detalle-producto", ".descripcion"), ("[class*=producto]", "[class*=nombre]"), ("[class*=producto]", "[class*=descripcion]"), ("[class*=product]", "[class*=name]"), ("[class*=product]", "[class*=description]"))),
    ("[class*=tag]", "leaves"), ("h1", "leaves"), ("h2", "leaves"), ("h3", "leaves"),
]
SMALL: Ways = [("span, li, p, div, a", "leaves")]
HEAD: Ways = [("meta[property=og:title]", "content"), ("meta[name=og:title]", "content"), ("title", "text")]
#: The plain title that names are compared with.
PLAIN: Ways = [(s, "text") for s in ("h1", "h2", ".product-title", ".producto-titulo", ".nombre", ".name")]


def _like(walk: Walk, at: int, anchors: list[int]) -> bool:
    """Whether an element's text, or the addresses inside it, speak of a product."""
    begin, end = walk.spans[at]
    inside = anchors[bisect_left(anchors, at) : bisect_right(anchors, walk.last[at])]
    return bool(LIKE.search(walk.text, begin, end) or any(LIKE.search(walk.values[i].get("href", "")) for i in inside if i != at))


def _around(walk: Walk, link: int, anchors: list[int]) -> int | None:
    """The widest element around a link that is a product's and has no long text."""
    best, at = None, link
    while at >= 0:
        begin, end = walk.spans[at]
        if end - begin > LONGEST + 1:
            break
        if _like(walk, at, anchors):
            best = at
        at = walk.parent[at]
    return best


def choose_cards(walk: Walk, found: list[list[int]]) -> list[int]:
    """Of the first tier that has any, the elements that are products'; without any the page's first element, if it is one."""
    anchors, links = walk.found[2], found[0]
    marked, broad = found[1 : 1 + len(MARKED)], found[1 + len(MARKED) : 1 + len(MARKED) + len(BROAD)]
    for tier in marked:
        if good := [at for at in tier if _like(walk, at, anchors)]:
            return good
    if around := [at for at in dict.fromkeys(_around(walk, link, anchors) for link in links) if at is not None]:
        return around
    for tier in broad:
        if good := [at for at in tier if bisect_right(links, at) < bisect_right(links, walk.last[at]) and _like(walk, at, anchors)]:
            return good
    return [-1] if LIKE.search(walk.text) else []


def choose_detail(walk: Walk, found: list[list[int]]) -> list[int]:
    """The element of least text among those of the first selector that finds a product's, else the least around a link; else the page."""
    anchors, size = walk.found[2], lambda at: walk.spans[at][1] - walk.spans[at][0]
    for tier in found[1:]:
        if good := [at for at in tier if _like(walk, at, anchors)]:
            return [min(good, key=size)]
    around = [at for at in (_around(walk, link, anchors) for link in found[0]) if at is not None]
    return [min(around, key=size)] if around else [-1]


def _labelled(name: str) -> Column:
    others = [x for n, x in LABELS.items() if n != name] + ([SKU] if name != "sku" else [])
    return labelled_value(F.col("card_text"), SKU if name == "sku" else LABELS[name], others)


def _records(found: DataFrame, name: Column) -> DataFrame:
    link = urls.catalog_url(urls.resolve_url(F.col("url"), F.col("link")))
    rows = found.withColumns({"_link": F.coalesce(link, F.col("url")), "_image": urls.catalog_url(urls.resolve_url(F.col("url"), F.col("image"))), "_name": F.coalesce(name, names.clean_name(_labelled("producto")))})
    amount = F.coalesce("price_text", F.nullif(F.regexp_extract("card_text", PRICED, 1), F.lit("")))
    state = F.nullif(availability(F.col("card_text")), F.lit("unknown"))
    attributes = F.map_filter(F.create_map(*(x for n in ("referencia", "llegada", "procedencia") for x in (F.lit(n), _labelled(n)))), lambda _, v: v.isNotNull())
    vehicle = F.coalesce(_labelled("marca_vehiculo"), _labelled("marca"))
    out = rows.select(
        F.col("url").alias("page_url"), "card", F.coalesce("_name", names.name_from_url(F.col("_link"))).alias("product_name"), F.col("_link").alias("source_url"), F.coalesce(clean_text(F.col("code")), _labelled("sku")).alias("sku"), _labelled("marca").alias("brand"),
        price.portal_price(amount).alias("price"), price.infer_currency(F.lit(None).cast("string"), amount).alias("currency"), state.alias("availability"), F.col("_image").alias("image_url"), label_case(_labelled("categoria")).alias("category"),
        F.when(vehicle.isNotNull(), F.array(vehicle)).alias("compatible_brands"), F.when(_labelled("modelo").isNotNull(), F.array(_labelled("modelo"))).alias("compatible_models"), attributes.alias("attributes"),
    )
    return out.where(F.col("product_name").isNotNull() | F.col("sku").isNotNull())


def listing_records(pages: DataFrame) -> DataFrame:
    """Records of the cards of pages (url, html); a card without a name and a code gives none."""
    found = cards(pages, Request(Boxes(choose=choose_cards, parts=(LINK, *MARKED, *BROAD)), PARTS))
    return _records(found, names.clean_name(F.col("title")))


def detail_records(pages: DataFrame) -> DataFrame:
    """A record of each detail page (url, html), by the best of the names that it shows."""
    asked = {f"h{i}": (s, {"x": "content" if a == "content" else "text"}) for i, (s, a) in enumerate(HEAD)}
    headed = find(pages.select("url", "html"), asked)
    first = F.array_compact(F.array(*(F.get(F.col(f"_found.{n}"), F.lit(0))["x"] for n in asked)))
    found = cards(headed.select("url", "html", first.alias("head")), Request(Boxes(choose=choose_detail, parts=(LINK, *DETAILS)), {**PARTS, "plain": PLAIN}, {"named": NAMED, "small": SMALL}), "head")
    small = F.filter("small", lambda x: F.length(x).between(8, 180) & x.rlike("[A-Z0-9]"))
    return _records(found, names.best_name(F.concat("named", small, "head"), F.col("plain"))).withColumn("source_url", F.col("page_url"))
