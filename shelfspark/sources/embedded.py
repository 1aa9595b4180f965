"""Products that pages carry as JSON in their scripts, several to a page: scored, folded in order of score, and their images.

Python finds the objects and what of them may be an image; which of them count, how they
are folded and which images are a product's are functions of one array a page.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, decode_entities, let
from .selectors import Selectors, Walk, of_pages

# Names of fields, and of parts of pages, that these shops use; what an image's address holds, and what it must not.
PRODUCT, FIELDS, VARIANTS = "producto", ("precioMonto", "moneda", "carac", "tieneStock"), ("variantes", "variante", "variaciones")
CODES, SIGNALS = ("codigo", "codigocompleto", "sku", "com"), ("codigo", "codigocompleto", "sku", "com", "img", "imagen", "image", "foto", "galeria", "imagenes", "images")
PRODUCT_IMAGES = ("img", "imagen", "image", "urlImagen", "urlimagen", "foto", "fotoPrincipal", "imagenPrincipal", "imagenes", "images", "fotos", "galeria", "galería")
VARIANT_IMAGES = ("img", "imagen", "image", "foto", "fotos", "imagenes", "images", "galeria", "galería", "fotoPrincipal", "imagenPrincipal", "urlImagen")
SCRIPTS = '"producto"\\s*:|precioMonto|tieneStock|"variantes?"\\s*:|"variaciones"\\s*:'
DATA_ELEMENT = "jsonDataFicha"
IMAGE = "(?i)\\.(?:avif|webp|jpe?g|png|gif)(?:[?#]|$)"
NO_IMAGE = "(?i)topbar|banner|ayala-ecommerce|placeholder|sin[-_]?imagen|no[-_]?image|relacionad|footer|header|sprite|icon|favicon|loading|loader|blank|default|pixel|analytics|facebook|instagram|whatsapp|logoMarca|medios?[-_]?pago"
LOGO = "(?i)(?:^|[/_*.-])logo(?:[/_*.-]|$)"
RELATED = "relacionad|recomendad|similares|tambien|también|otros-productos|aListProductos|listProductos|productosRelacionados"
LIKELY = "aFichaProducto|fichaProducto|fichaImagenes|imagenProducto|producto(?:__)?(?:imagen|foto|galeria)|imagenes|galeria|thumb|zoom|swiper|slick|carousel|foto|image|pic"
CONTAINERS = (
    "#fichaProducto .fichaImagenes", "#fichaProducto .imagenProducto", "#fichaProducto .swiperThumbs", "#fichaProducto img[itemprop=image]", ".imagenes", ".galeriaProducto", ".producto__imagenes", ".producto-imagenes", ".productoImagenes",
    ".fichaProducto .imagenes", ".aFichaProducto .imagenes", ".fichaProducto [class*=galeria]", ".aFichaProducto [class*=galeria]", ".fichaProducto [class*=gallery]", ".aFichaProducto [class*=gallery]", ".fichaProducto [class*=zoom]", ".aFichaProducto [class*=zoom]",
    ".fichaProducto [class*=swiper]", ".aFichaProducto [class*=swiper]", ".fichaProducto [class*=slick]", ".aFichaProducto [class*=slick]", "[data-gallery]", "[data-product-gallery]", "[class*=producto][class*=imagen]", "[class*=producto][class*=galeria]",
)
SHOWN = ("[data-zoom-image]", "[data-large-image]", "[data-full]", "[data-src-g]", "[data-src]", "[data-original]", "[data-standard]", "img[itemprop=image]", "img[src]", "source[srcset]", "a[href]")
ADDRESSES, SETS = ("data-zoom-image", "data-large-image", "data-full", "data-src-g", "data-src", "data-original", "data-standard", "src", "href"), ("srcset", "data-srcset")
META = ("meta[property=og:image]", "meta[name=twitter:image]")
#: What counts for a product of several: a matching variant with images, any variant's images, own images, each known field.
MATCHED, OF_VARIANTS, OWN, FIELD = 10_000, 5_000, 1_000, 100


def _label(key: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", key) if not "̀" <= c <= "ͯ").lower()
    return "".join(c for c in bare if c.isascii() and c.isalnum())


def _written(value: object) -> str | None:
    """A text as it is, null as None, anything else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, str) or isinstance(value, (int, float)) and not isinstance(value, bool):
        yield str(value)
    elif isinstance(value, (list, dict)):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _leaves(x)


def _objects(value: object) -> Iterator[dict]:
    """Objects at any depth, outer ones first."""
    stack = [value]
    while stack:
        now = stack.pop()
        if isinstance(now, dict):
            yield now
            stack.extend(reversed(now.values()))
        elif isinstance(now, list):
            stack.extend(reversed(now))


def _code(record: dict, names: tuple[str, ...]) -> list[str]:
    texts = (" ".join(str(v).split()) for k, v in record.items() if _label(k) in names and isinstance(v, (str, int, float)) and not isinstance(v, bool))
    return [x for x in texts if x]


def _variants(value: object) -> list[dict]:
    return [{"codes": _code(x, CODES), "images": [v for k in VARIANT_IMAGES for v in _leaves(x.get(k))]} for x in _objects(value) if any(_label(k) in SIGNALS for k in x)]


def products_in(texts: list[str]) -> list[dict]:
    """The products in JSON inside of texts: in order of texts, the shorter first."""
    out = []
    decoder = json.JSONDecoder()
    for text in texts:
        found, at = [], text.find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
                continue
            found += [x for x in _objects(value) if isinstance(x.get(PRODUCT), dict) and any(k in x for k in (*FIELDS, *VARIANTS))]
            at = text.find("{", end)
        out += sorted(({"text": _written(x), "value": x} for x in found), key=lambda x: len(x["text"]))
    return [
        {
            "code": next(iter(_code(x["value"][PRODUCT], ("codigo",))), None),
            "size": len(x["text"]),
            "keys": len(x["value"]),
            "product": [(k, _written(v)) for k, v in x["value"][PRODUCT].items()],
            "product_images": [(k, list(_leaves(x["value"][PRODUCT][k]))) for k in PRODUCT_IMAGES if k in x["value"][PRODUCT]],
            **{k: _written(x["value"].get(k)) for k in FIELDS},
            **{k: _variants(x["value"][k]) if k in x["value"] and x["value"][k] is not None else None for k in VARIANTS},
            "named": sum(k in x["value"] for k in (PRODUCT, *FIELDS, *VARIANTS)),
        }
        for x in out
    ]


_VARIANT, _VARIANT_TYPE = "array<struct<codes:array<string>,images:array<string>>>", pa.list_(pa.struct([("codes", pa.list_(pa.string())), ("images", pa.list_(pa.string()))]))
_KINDS = [
    ("code", "string", pa.string()), ("size", "int", pa.int32()), ("keys", "int", pa.int32()), ("named", "int", pa.int32()), ("product", "map<string,string>", pa.map_(pa.string(), pa.string())),
    ("product_images", "map<string,array<string>>", pa.map_(pa.string(), pa.list_(pa.string()))), *((f, "string", pa.string()) for f in FIELDS), *((v, _VARIANT, _VARIANT_TYPE) for v in VARIANTS),
]
CANDIDATES = "array<struct<" + ",".join(f"{n}:{t}" for n, t, _ in _KINDS) + ">>"


def _found(texts: Column) -> Column:
    return of_pages(texts, pa.list_(pa.struct([(n, k) for n, _, k in _KINDS])), CANDIDATES, lambda x: products_in([t or "" for t in x or []]))


def product_scripts(html: Column) -> Column:
    """The text of the page's data element, then the scripts that speak of a product."""
    data = F.regexp_extract(html, f"(?is)<(\\w+)[^>]*\\bid=[\"']?{DATA_ELEMENT}\\b[^>]*>(.*?)</\\1\\s*>", 2)
    scripts = F.regexp_extract_all(html, F.lit("(?is)<script\\b[^>]*>(.*?)</script\\s*>"), F.lit(1))
    return F.concat(F.array(decode_entities(data)), F.filter(scripts, lambda x: x.rlike(SCRIPTS)))


def absolute(link: Column, page: Column) -> Column:
    """A link as an absolute http address by expressions alone: steps like ``..`` stay as they are; null for other schemes."""
    origin, folder = F.regexp_extract(page, "(?i)^(https?://[^/?#]+)", 1), F.regexp_extract(page, "(?i)^(https?://[^/?#]+(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike("(?i)^https?://[^/?#\\s]"), link).when(link.startswith("//"), F.concat(F.regexp_extract(page, "(?i)^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link)).when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(folder, link))
    )


def image_addresses(values: Column, page: Column) -> Column:
    """Of texts that may be images, the distinct addresses of those that are images of products, in order."""

    def one(value: Column) -> Column:
        text = clean_text(value)
        for pattern, sign in (("\\\\u002[fF]", "/"), ("\\\\/", "/"), ("&amp;", "&"), ("(?i)^url\\((['\"]?)(.*?)\\1\\)$", "$2"), ("^['\"]|['\"]$", "")):
            text = F.regexp_replace(text, pattern, sign)
        decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
        return F.replace(absolute(F.nullif(decoded, F.lit("")), page), F.lit(" "), F.lit("%20"))

    path = lambda x: F.regexp_extract(x, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    good = lambda x: x.isNotNull() & x.rlike(IMAGE) & ~x.rlike(NO_IMAGE) & ~path(x).rlike(LOGO)
    return F.array_distinct(F.filter(F.transform(values, one), good))


def _of_variants(candidate: Column, sku: Column) -> tuple[Column, Column]:
    """(whether a variant matches the code, images of those that do, or else of all)."""
    every = F.flatten(F.array_compact(F.array(*(candidate[v] for v in VARIANTS))))
    matches = lambda v: sku.isNull() | F.exists(v["codes"], lambda c: F.contains(c, sku))
    matching = F.filter(every, matches)
    chosen = F.when(F.size(matching) > 0, matching).otherwise(every)
    return F.size(matching) > 0, F.flatten(F.transform(chosen, lambda v: v["images"]))


def _own_images(candidate: Column) -> Column:
    held = lambda k: F.coalesce(F.try_element_at(candidate["product_images"], k), F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(*map(F.lit, PRODUCT_IMAGES)), held))


def score(candidate: Column, sku: Column, page: Column) -> Column:
    """How much a candidate says of the product."""
    matched, images = _of_variants(candidate, sku)
    some = F.size(image_addresses(images, page)) > 0
    own = F.size(image_addresses(_own_images(candidate), page)) > 0
    points = F.when(matched & some, MATCHED).otherwise(0) + F.when(some, OF_VARIANTS).otherwise(0) + F.when(own, OWN).otherwise(0)
    return points + candidate["named"] * FIELD + candidate["keys"] + candidate["size"] / 10_000


def embedded_products(pages: DataFrame, sku: Column | None = None) -> DataFrame:
    """``pages`` (url, html and others) with ``embedded``: the page's products folded into one, null if it has none; ``sku`` is the code that the page is known by.

    Products of that code alone count if there are any. They are folded in ascending order of
    score: a later one's fields, and the fields of its product, go over an earlier one's.
    """
    code = F.lit(None).cast("string") if sku is None else clean_text(sku)
    found = pages.withColumn("_code", code).withColumn("_found", _found(product_scripts(F.col("html"))))
    own = F.filter("_found", lambda c: c["code"] == F.col("_code"))
    chosen = F.when(F.size(own) > 0, own).otherwise(F.col("_found"))
    ranked = F.transform(chosen, lambda c, i: F.struct(score(c, F.col("_code"), F.col("url")).alias("score"), i.alias("place"), c.alias("c")))

    def over(left: Column, right: Column, name: str) -> Column:
        kept = F.map_filter(left[name], lambda k, _: ~F.map_contains_key(right[name], k))
        return F.map_concat(kept, right[name])

    def fold(left: Column, right: Column) -> Column:
        maps = [over(left, right, n).alias(n) for n in ("product", "product_images")]
        return F.struct(*(x for n, _, _ in _KINDS for x in ([maps[n == "product_images"]] if n in ("product", "product_images") else [F.coalesce(right[n], left[n]).alias(n)])))

    # Places are distinct, so the order never compares the candidates themselves, which have maps.
    order = F.sort_array(F.transform("_ranked", lambda r: F.struct(r["score"].alias("score"), r["place"].alias("place"))))
    ordered = F.transform(order, lambda o: F.get(F.col("_ranked"), o["place"])["c"])
    merged = let(ordered, lambda cs: F.aggregate(F.slice(cs, 2, F.greatest(F.size(cs), F.lit(1))), F.get(cs, F.lit(0)), fold))
    return found.withColumn("_ranked", ranked).withColumn("embedded", F.when(F.size("_ranked") > 0, merged)).drop("_found", "_ranked", "_code")


def embedded_images(sku: Column | None = None) -> Column:
    """Texts that may be images of the folded product: its variants' (of the code, if any is), then its own; null if it has another code."""
    code = F.lit(None).cast("string") if sku is None else clean_text(sku)
    own = F.col("embedded")
    fits = own.isNotNull() & F.coalesce(own["code"] == code, F.lit(True))
    return F.when(fits, F.concat(_of_variants(own, code)[1], _own_images(own)))


def _shown(walk: Walk) -> list[str]:
    """Images of a page's galleries, container by container; nothing inside a container of other products."""
    n = len(CONTAINERS)
    related = walk.found[-1]
    ends: list[tuple[int, int]] = []
    for at in related:
        if not ends or at > ends[-1][1]:
            ends.append((at, walk.last[at]))
    starts = [a for a, _ in ends]

    def other(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i >= 0 and at <= ends[i][1]

    out = []
    for box in dict.fromkeys(at for found in walk.found[:n] for at in found):
        if other(box):
            continue
        for found in walk.found[n : n + len(SHOWN)]:
            for at in found[bisect_right(found, box) : bisect_right(found, walk.last[box])]:
                values = walk.values[at]
                named = " ".join(values[k] for k in ("class", "id", "alt", "title") if values.get(k))
                if other(at) or named and not re.search(LIKELY, named, re.I) and walk.tags[at] not in ("img", "source"):
                    continue
                out += [values[k] for k in ADDRESSES if values.get(k)]
                out += [x.split()[0] for k in SETS for x in values.get(k, "").split(",")[:1] if x.split()]
    return out


class _Gallery(Walk):
    """A walk that also knows elements of other products, by class or id, as its last selector."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = len(self.last)
        super().handle_starttag(tag, attrs)
        self.tags[at] = tag
        named = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        if named and re.search(RELATED, named, re.I):
            self.found[-1].append(at)


def shown_images(html: Column) -> Column:
    """(meta, shown): texts that may be images, of the page's head and of its galleries."""
    asked = [*CONTAINERS, *SHOWN, *META]
    selectors = Selectors(asked)

    def one(page: str | None) -> dict:
        walk = _Gallery(selectors, len(asked) + 1, page or "")
        meta = [walk.values[found[0]].get("content") for found in walk.found[len(CONTAINERS) + len(SHOWN) : -1] if found]
        return {"meta": [x for x in meta if x], "shown": _shown(walk)}

    return of_pages(html, pa.struct([("meta", pa.list_(pa.string())), ("shown", pa.list_(pa.string()))]), "struct<meta:array<string>,shown:array<string>>", one)


def product_images(pages: DataFrame, sku: Column | None = None, linked: Column | None = None) -> DataFrame:
    """``embedded_products`` with ``image_urls``: the head's images, the embedded product's, the galleries', then ``linked`` (linked data's, of the same product)."""
    found = embedded_products(pages, sku).withColumn("_shown", shown_images(F.col("html")))
    none = F.array().cast("array<string>")
    every = F.concat("_shown.meta", F.coalesce(embedded_images(sku), none), "_shown.shown", F.coalesce(linked, none) if linked is not None else none)
    return found.withColumn("image_urls", image_addresses(every, F.col("url"))).drop("_shown")


def embedded_records(pages: DataFrame, sku: Column | None = None) -> DataFrame:
    """(url, sku, product_name, price, currency, category, brand, availability, image_url, image_urls) of pages that carry a product."""
    found = product_images(pages, sku).where("embedded is not null")
    held = lambda name: clean_text(F.try_element_at("embedded.product", F.lit(name)))
    state = F.lower("embedded.tieneStock")
    return found.select(
        "url", F.coalesce("embedded.code", clean_text(sku) if sku is not None else F.lit(None)).alias("sku"), held("nombre").alias("product_name"), clean_text(F.col("embedded.precioMonto")).alias("price"),
        F.coalesce(F.get_json_object("embedded.moneda", "$.cod"), F.lit("UYU")).alias("currency"), held("categoria").alias("category"), held("marca").alias("brand"),
        F.when(state.isin("true", "1"), "in_stock").when(state.isin("false", "0"), "out_of_stock").alias("availability"), F.get("image_urls", F.lit(0)).alias("image_url"), "image_urls",
    )
