"""Records of rendered pages of any shop: linked data, cards around links, and the page itself, merged by address."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, urls
from ..functions.text import clean_text
from . import feeds
from .selectors import Selectors, Walk, of_pages

# Amounts, links and names that are no products', brands, sentences on shipping, and the longest text of a card.
PRICED = re.compile(r"(?:US\$|\$|UYU|USD)\s*[0-9.,]+|[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{2})\s*(?:US\$|\$|UYU|USD)?", re.I)
NO_LINK = re.compile("contacto|carrito|login|checkout|terminos|privacidad|inicio|home|menu", re.I)
NO_NAME = re.compile("ver m[aá]s|home|men[uú]|precio|buscar|vista r[aá]pida|agregar al carrito", re.I)
CUT = re.compile(r"vista r[aá]pida|agregar al carrito|precio(?: de oferta)?[\s:$]*.*$", re.I)
BRANDS = re.compile("toyota|nissan|fiat|ford|volkswagen|vw|renault|peugeot|citroen|hyundai|kia|chevrolet|suzuki|mazda|mitsubishi|chery|geely|byd", re.I)
SHIPPING = re.compile("env[ií]o|retiro|pickup|delivery|despacho", re.I)
GONE, THERE = re.compile("agotado|sin stock|out of stock", re.I), re.compile("en stock|disponible|add to cart|agregar al carrito", re.I)
LONGEST, SENTENCES, SHORTEST_NAME = 800, 5, 4
LINKED = "(?is)<script\\b[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script\\s*>"

ASKED = [
    "a[href]", "h1", "h2", "h3", "h4", "[class*=title]", "[class*=name]", "img", "main", "meta[property=og:image]", "[class*=breadcrumb] li, [class*=breadcrumb] a", "meta[name=description]",
    "[class*=description], .woocommerce-product-details__short-description, article, main", "table tr, [class*=attributes] tr", "th, td", "body",
]
NAMES = [1, 2, 3, 4, 5, 6, 0]
FIELDS = ["product_name", "price_text", "link", "image", "availability", "category", "description"]
_KIND = pa.list_(pa.struct([("place", pa.int32()), *((f, pa.string()) for f in FIELDS), ("compatible_brands", pa.list_(pa.string())), ("shipping_info", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string()))]))
_SCHEMA = "array<struct<place:int," + ",".join(f"{f}:string" for f in FIELDS) + ",compatible_brands:array<string>,shipping_info:array<string>,attributes:map<string,string>>>"


def _name(text: str | None) -> str:
    return CUT.sub("", text or "").strip()


def _state(text: str) -> str | None:
    return "out_of_stock" if GONE.search(text) else "in_stock" if THERE.search(text) else None


def _brands(text: str) -> list[str]:
    return list(dict.fromkeys(BRANDS.findall(text)))


class _Page:
    """One page's texts, with what has been looked up in them."""

    def __init__(self, walk: Walk) -> None:
        self.walk, self.priced = walk, {}

    def text(self, at: int) -> str:
        return self.walk.value(at, "text") or ""

    def amount(self, at: int) -> str | None:
        if at not in self.priced:
            found = PRICED.search(self.text(at))
            self.priced[at] = found[0] if found else None
        return self.priced[at]

    def inside(self, selector: int, box: int) -> list[int]:
        return [at for at in self.walk.found[selector] if box < at <= self.walk.last[box]]

    def container(self, at: int) -> int:
        """The nearest element from the link up whose text is short and has an amount; else the one above."""
        body, up = self.walk.found[15][:1], at
        while up >= 0 and [up] != body:
            begin, end = self.walk.spans[up]
            if 0 < end - begin <= LONGEST + 1 and self.amount(up):
                return up
            up = self.walk.parent[up]
        return self.walk.parent[at] if self.walk.parent[at] >= 0 else at

    def price(self, box: int) -> str | None:
        return next((x for at in range(box + 1, self.walk.last[box] + 1) if (x := self.amount(at))), None) or self.amount(box)

    def name(self, box: int) -> str | None:
        for selector in NAMES:
            for at in self.inside(selector, box)[:1]:
                value = _name(self.text(at))
                if len(value) >= SHORTEST_NAME and not PRICED.search(value) and not NO_NAME.search(value):
                    return value
        return None

    def image(self, box: int) -> str | None:
        for at in self.inside(7, box)[:1]:
            values = self.walk.values[at]
            return values.get("src") or values.get("data-src") or next((x.split()[0] for x in values.get("srcset", "").split(",")[:1] if x.split()), None)
        return None


def _cards(page: _Page) -> list[dict]:
    out = []
    for at in page.walk.found[0]:
        href = page.walk.values[at]["href"]
        if NO_LINK.search(href):
            continue
        box = page.container(at)
        name = _name(page.text(at)) or page.name(box)
        if name and not NO_NAME.search(name):
            text = page.text(box)
            out.append({"product_name": name, "price_text": page.price(box), "link": href, "image": page.image(box), "availability": _state(text), "compatible_brands": _brands(text)})
    return out


def _whole(page: _Page) -> list[dict]:
    """The page as a record, if it has a heading."""
    walk = page.walk
    heading = next((_name(page.text(at)) for at in walk.found[1][:1]), "")
    if not heading:
        return []
    text = walk.text.rstrip(" ")
    first = lambda selector, what: next((v for at in walk.found[selector][:1] if (v := walk.value(at, what))), None)
    amount = PRICED.search(text)
    box = next(iter(walk.found[8]), next(iter(walk.found[15]), 0))
    crumbs = [at for at in walk.found[10] if _last_of_kind(walk, at)]
    attributes = {}
    for row in walk.found[13]:
        cells = [v for at in page.inside(14, row) if (v := page.text(at))]
        if len(cells) > 1:
            attributes[cells[0]] = " / ".join(cells[1:])
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text) if SHIPPING.search(x)][:SENTENCES]
    return [
        {
            "product_name": heading, "price_text": amount[0] if amount else None, "image": first(9, "content") or page.image(box), "category": page.text(crumbs[0]) if crumbs else None, "description": first(11, "content") or first(12, "text"),
            "availability": _state(text), "compatible_brands": _brands(text), "shipping_info": sentences, "attributes": list(attributes.items()),
        }
    ]


def _last_of_kind(walk: Walk, at: int) -> bool:
    """Whether no element follows this one inside the element above it."""
    up = walk.parent[at]
    return up < 0 or walk.last[up] == walk.last[at]


def _found(html: Column) -> Column:
    selectors = Selectors(ASKED)

    def one(text: str | None) -> list[dict]:
        page = _Page(Walk(selectors, len(ASKED), text or ""))
        return [{"place": i, **x} for i, x in enumerate([*_cards(page), *_whole(page)])]

    return of_pages(html, _KIND, _SCHEMA, one)


def rendered_records(pages: DataFrame) -> DataFrame:
    """Records of pages (url, html): of linked data, then of cards, then of the page; of one address the last one counts.

    What the last one does not know of availability, images, shipping, brands and attributes stays
    as an earlier one has it.
    """
    blocks = F.filter(F.regexp_extract_all("html", F.lit(LINKED), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())
    scripts = pages.select("url", F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")).alias("body"))
    none = F.lit(None)
    lists = ("compatible_brands", "shipping_info")
    linked = feeds.linked_data_products(scripts).select(
        F.col("url").alias("page_url"), F.struct(F.lit(0).alias("kind"), F.col("place").alias("place")).alias("place"), "product_name", "price", "currency", "brand", none.cast("string").alias("category"), none.cast("string").alias("description"),
        "availability", "source_url", "image_url", *(none.cast("array<string>").alias(c) for c in lists), none.cast("map<string,string>").alias("attributes"),
    )
    rows = pages.select("url", F.inline(_found(F.col("html"))))
    link, image = (urls.resolve_url(F.col("url"), F.col(c)) for c in ("link", "image"))
    kept = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    shown = rows.select(
        F.col("url").alias("page_url"), F.struct(F.lit(1).alias("kind"), F.col("place").alias("place")).alias("place"), clean_text(F.col("product_name")).alias("product_name"), price.normalize_price(F.col("price_text")).alias("price"),
        F.when(F.col("price_text").isNotNull(), price.infer_currency(none.cast("string"), F.col("price_text"))).alias("currency"), none.cast("string").alias("brand"), clean_text(F.col("category")).alias("category"), clean_text(F.col("description")).alias("description"),
        "availability", F.when(F.col("link").isNull(), F.col("url")).otherwise(link).alias("source_url"), image.alias("image_url"), *map(kept, lists), kept("attributes"),
    )
    both = linked.unionByName(shown).where(F.col("product_name").isNotNull() & F.col("source_url").isNotNull())
    core = ("product_name", "price", "currency", "brand", "category", "description", "source_url")
    known = ("availability", "image_url", *lists, "attributes")
    last = [F.max_by(F.struct(*core), "place").alias("r"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in known), F.min("place").alias("first")]
    merged = both.groupBy("page_url", F.lower("source_url").alias("_key")).agg(*last)
    return merged.select("page_url", F.col("first.kind").alias("kind"), F.col("first.place").alias("place"), "r.*", *known, F.when(F.col("availability") == "out_of_stock", "0").alias("stock"))
