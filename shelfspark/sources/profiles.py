"""How the pages of a kind of shop are read: data for the generic readers, no code per site."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, urls
from ..functions.text import brand_from_text, clean_text, fold
from . import feeds, html, selectors
from .selectors import Boxes, Request, Ways

# Amounts with a currency inside of texts, and the label before a code.
PRICED = "(?i)((?:US\\$|\\$U|\\$|UYU|USD)\\s*[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?)"
CODE = "(?i)(?:sku|c[oó]d(?:igo)?(?:\\s+del\\s+producto)?)?\\s*[:#-]?\\s*([a-z]\\d{5,}|[a-z0-9][a-z0-9._-]{4,})"
CODE_IN_SLUG = "(?i)(?:^|[-/])([a-z]\\d{5,})/?$"
#: What ``price_text`` falls back to: the first of these that holds an amount, then all of the card's text.
ANY_PRICE: Ways = [(".price", "text"), ("[class*=price]", "text"), ("[class*=precio]", "text"), ("p", "text"), ("div", "text")]


@dataclass(frozen=True)
class Contract:
    """What a page has to hold, and where. Fields without a way here are null; ``lists`` hold all values of theirs."""

    fields: dict[str, Ways]
    lists: dict[str, Ways] = field(default_factory=dict)
    #: Selectors: a card holds at least one of these.
    holds: tuple[str, ...] = ()
    #: The address, the page's own for details, has to fit the first and must not fit the second.
    address: str = ""
    not_address: str = "(?!)"
    needs_price: bool = False
    #: Where a card's whole text is searched for an amount if no way gives one.
    price_in_text: bool = False
    #: A name is cut from where the first fits; a folded name that the second fits is none.
    name_cut: tuple[str, ...] = ()
    no_name: str = "(?!)"
    #: Availability: always this; else ``state_text``, then the whole text; ``out_class`` on the card and ``out_text`` in a field go before.
    always: str = ""
    states: bool = True
    out_class: str = ""
    #: A code is upper-case, found after a label or at the end of the address.
    coded: bool = False
    #: Pages whose text says that they do not exist give nothing.
    rejects_missing: bool = False
    #: The anchor around a card may be its link.
    link_above: bool = False


@dataclass(frozen=True)
class Profile:
    """``cards`` selects a listing's cards; fields come before the generic fallbacks. Contracts stand for themselves. A feed has no cards."""

    cards: str = ""
    card_fields: dict[str, Ways] = field(default_factory=dict)
    detail_fields: dict[str, Ways] = field(default_factory=dict)
    needs_price: bool = True
    listing: Contract | None = None
    detail: Contract | None = None


def _ways(text: str) -> Ways:
    """Ways after bars; an attribute after ``@``."""
    return [(s.strip(), a.strip() or "text") for s, _, a in (x.partition("@") for x in text.split(" | "))]


def _fields(**ways: str) -> dict[str, Ways]:
    return {k: _ways(v) for k, v in ways.items()}


IMAGE = "img@src | img@data-src"
IMAGES = "img@src | img@data-src | img@data-lazy-src"
BUYING = "[class*=stock] | .enstock | #producto_agotado | .opcionescarrito | form button | button[type=submit]"
NO_ITEM_NAME = "finalizar compra|agregar al carrito|comprar|ver mas|menu|inicio"

# Selectors, patterns and words of each kind of page.
PROFILES = {
    "generic": Profile(".product, .product-item, .product-card, [class*=product-item], [class*=producto]", needs_price=False),
    "woocommerce": Profile(
        "li.product, .product-item, .product-grid-item",
        {"product_name": [(".woocommerce-loop-product__title", "text")], "price_text": [("ins", "text"), (".woocommerce-Price-amount", "text")]},
        {"price_text": [(".woocommerce-Price-amount", "text")], "description": [(".woocommerce-product-details__short-description", "text"), ("#tab-description", "text")], "sku": [(".sku", "text")]},
    ),
    "fenicio": Profile("[data-codprod]", {"sku": [("[data-codprod]", "data-codprod")], "state_text": [("[data-disp]", "data-disp")], "price_text": [(".precio", "text"), ("strong", "text")]}, {}, needs_price=False),
    "cards": Profile("article", {"product_name": [("h2", "text"), ("h4", "text"), ("h5", "text")]}, {}, needs_price=False),
    "info_cards": Profile(
        ".product-item-container",
        listing=Contract(
            _fields(
                link="a[href*=/product/]@href",
                product_name=".product-info-title | a[href*=/product/] | h1 | h2 | h3 | h4 | [class*=title] | [class*=name]",
                price_text=".product-info-price .woocommerce-Price-currency | .product-info-price .woocommerce-Price-amount | .product-info-price | [class*=price-number]",
                description="p",
                image=IMAGE,
            ),
            _fields(image_urls=IMAGES),
            holds=(".product-info-title", ".product-info-price", ".price-number"),
            address="(?i)/product/",
            not_address="(?i)/product-category/",
            needs_price=True,
            price_in_text=True,
            name_cut=("(?i)\\bC[oó]d(?:igo)?\\b[\\s:#-]*[\\w.-]+\\b.*$", "(?i)\\b(?:Disponible|Consulte|Comprar|Añadir al carrito|Anadir al carrito|Agotado|Sin stock|Out of stock|No disponible)\\b.*$", "\\$\\s*[\\d.,]+.*$"),
            link_above=True,
        ),
        detail=Contract(
            _fields(
                product_name="h1.product-info-title | h1.product_title | h1",
                price_text=".product-info-price .price-number | .product-info-price .woocommerce-Price-amount | .product-info-price | .summary .price-number | [class*=price-number]",
                brand_text=".product-info-brand | .brand | .copete_ficha",
                description="#tab-description | .woocommerce-product-details__short-description | .summary p | meta[name=description]@content",
                image="figure img@src | .woocommerce-product-gallery img@src | img@src | meta[property=og:image]@content",
                state_text=BUYING,
            ),
            address="(?i)/product/",
            rejects_missing=True,
        ),
    ),
    "wrapper_cards": Profile(
        ".single-product-wrapper",
        listing=Contract(
            _fields(
                link="a[href*=/articulos/mostrar/]@href | h3 a[href]@href | h2 a[href]@href",
                product_name="h3 a | h2 a | [class*=title] | img@alt",
                price_text=".product-price | [class*=price] | .price | [class*=precio] | p | div",
                description=".product-description | .product-meta-data",
                image="img@src",
            ),
            needs_price=True,
            price_in_text=True,
            no_name="^(?:catalogo|inicio|home|menu|ver mas|mostrar|pagina)$",
        ),
    ),
    "article_cards": Profile(
        "article.card__producto--item",
        listing=Contract(
            _fields(
                link="h3 a[href]@href | .card__producto--item--img a[href]@href | .card__producto--item--info--titulo a[href]@href",
                product_name="h3 a | img@alt | .card__producto--item--info--titulo",
                price_text=".card__producto--item--info--tools--pie h4 | .card__producto--item--info--tools--pie .precio | .card__producto--item--info--tools--pie [class*=precio] | h4",
                description=".card__producto--item--info--titulo--modelos--linea--marcas",
                image=IMAGE,
            ),
            _fields(compatible_brands=".card__producto--item--info--titulo--modelos--linea--marcas h5"),
            needs_price=True,
            no_name="ver modelos",
            states=False,
        ),
    ),
    "stock_articles": Profile(
        "article.prod_item",
        listing=Contract(
            _fields(
                link="a[href*=/catalogo/]@href | a[itemprop=url]@href | h2 a@href",
                product_name="span[itemprop=name] | h1.nombre | h2 span[itemprop=name] | h2 .nombre | [itemprop=name] | img@alt | h2 a | h1",
                price_text="#precio_ent_actual | #precio_ent_actual@content | [itemprop=price] | [itemprop=price]@content | .precio_cont .entero | .prod_preciomas .entero | .pprecio | .precio_cont",
                brand_text=".copete_f | .copete_ficha",
                description=".copete_f | .copete_ficha",
                sku_text="[itemprop=sku] | [itemprop=sku]@content | .sku | .codigo | .cod_producto | [class*=codigo]",
                image=IMAGE,
                state_text=".enstock | #producto_agotado | .opcionescarrito",
                out_text=".stock_agotado | .agotado | #producto_agotado",
            ),
            price_in_text=True,
            no_name=NO_ITEM_NAME,
            out_class="prod_sin_stock",
            coded=True,
        ),
        detail=Contract(
            _fields(
                product_name="h1.nombre | h1[itemprop=name] | h1",
                price_text="#precio_ent_actual | #precio_ent_actual@content | [itemprop=price] | [itemprop=price]@content | .precio_cont .entero | .prod_preciomas .entero | .pprecio",
                brand_text=".copete_ficha | .copete_f",
                description=".copete_ficha | .copete_f",
                sku_text="[itemprop=sku] | [itemprop=sku]@content | .sku | .codigo | .cod_producto | [class*=codigo]",
                image="figure img@src | .prod_cont img@src | .foto img@src | img@src | meta[property=og:image]@content",
                state_text=BUYING,
            ),
            address="(?i)/catalogo/[^/?#]+/.+",
            no_name=NO_ITEM_NAME,
            coded=True,
            rejects_missing=True,
        ),
    ),
    "item_cards": Profile(
        ".product-item",
        listing=Contract(
            _fields(link=".pi-text a[href*=/product/]@href | a[href*=/product/]@href", product_name=".pi-text h5 | img@alt", price_text=".product-price", category=".catagory-name", image="img@data-src | img@src"),
            needs_price=True,
            address="(?i)/product/",
            always="in_stock",
        ),
    ),
    "reference_pages": Profile(
        "li.product",
        detail=Contract(
            _fields(
                product_name="h1.product_title | h1.product-title | h1",
                price_text=".woocommerce-Price-amount | .product-price | .price | [data-price] | .product_price",
                description=".woocommerce-product-details__short-description | .product-description | #tab-description | .summary p",
                image="img.wp-post-image@data-lazy-src | img.wp-post-image@data-src | img.wp-post-image@src | img[data-lazy-src]@data-lazy-src | img[data-src]@data-src | figure img@src | .product-image img@src | img[src]@src",
                state_text=BUYING,
            ),
            address="(?i)-ref-",
        ),
    ),
}


def _by_contract(found: DataFrame, contract: Contract, link: Column) -> DataFrame:
    """Records of the cards (or pages) that keep the contract."""
    have = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    name = F.col("product_name")
    for cut in contract.name_cut:
        name = F.regexp_replace(name, cut, "")
    in_text = F.nullif(F.regexp_extract("card_text", PRICED, 1), F.lit("")) if contract.price_in_text else F.lit(None).cast("string")
    whole = F.when(price.normalize_price(F.col("card_text")).isNotNull(), F.col("card_text")) if contract.price_in_text and contract.needs_price else F.lit(None).cast("string")
    amount = F.coalesce("price_text", in_text, whole)
    if contract.always:
        state = F.lit(contract.always)
    elif not contract.states:
        state = F.lit(None).cast("string")
    else:
        out = (F.array_contains("card_classes", contract.out_class) if contract.out_class else F.lit(False)) | (html.known_state(have("out_text")) == "out_of_stock")
        state = F.when(F.coalesce(out, F.lit(False)), "out_of_stock").otherwise(F.coalesce(html.known_state(have("state_text")), html.known_state(F.concat_ws(" ", have("state_text"), "card_text"))))
    code = F.upper(F.coalesce(F.nullif(F.regexp_extract(have("sku_text"), CODE, 1), F.lit("")), F.nullif(F.regexp_extract(urls.path_of(link), CODE_IN_SLUG, 1), F.lit("")))) if contract.coded else have("sku")
    image = urls.resolve_url(F.col("url"), F.col("image"))
    out = found.withColumn("_link", link).select(
        clean_text(name).alias("product_name"), price.normalize_price(amount).alias("price"), price.infer_currency(F.lit(None).cast("string"), amount).alias("currency"), brand_from_text(have("brand_text")).alias("brand"), code.alias("sku"), have("category").alias("category"), have("description").alias("description"),
        state.alias("availability"), F.col("_link").alias("source_url"), urls.catalog_url(image).alias("image_url"), *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in contract.lists), F.col("url").alias("page_url"), "card", "card_text",
    )
    kept = out.where(F.col("product_name").isNotNull() & F.col("source_url").isNotNull() & ~fold(F.col("product_name")).rlike(contract.no_name))
    if contract.address:
        kept = kept.where(F.col("source_url").rlike(contract.address) & ~F.col("source_url").rlike(contract.not_address))
    if contract.rejects_missing:
        kept = kept.where(~fold(F.col("card_text")).rlike(html.MISSING_PAGE))
    return (kept.where(F.col("price").isNotNull()) if contract.needs_price else kept).drop("card_text")


def listing_records(profile: Profile, pages: DataFrame) -> DataFrame:
    """Records of the cards of listing pages (url, html) that keep the profile's contract; a link that a page has twice counts once."""
    contract = profile.listing
    boxes = Boxes(profile.cards, contract.holds, link_above=contract.link_above)
    found = selectors.cards(pages, Request(boxes, contract.fields, contract.lists, ("price_text",)))
    out = _by_contract(found, contract, urls.catalog_url(urls.resolve_url(F.col("url"), F.col("link"))))
    return out.groupBy("page_url", "source_url").agg(F.min_by(F.struct(*out.columns), "card").alias("r")).select("r.*")


def detail_records(profile: Profile, pages: DataFrame) -> DataFrame:
    """A record of each page (url, html) that keeps the profile's contract."""
    contract = profile.detail
    found = selectors.cards(pages, Request(Boxes(), contract.fields, contract.lists, ("price_text",)))
    return _by_contract(found, contract, urls.catalog_url(F.col("url")))


def anchored_records(pages: DataFrame, link_pattern: str) -> DataFrame:
    """Records of listing pages without known cards: a link that fits, and the card that is climbed to from it."""
    found = selectors.cards(pages, Request(Boxes(climb=link_pattern), {**html.CARD_FIELDS, "price_text": ANY_PRICE}, amounts=("price_text",)))
    contract = Contract({}, needs_price=False, price_in_text=True)
    out = _by_contract(found, contract, urls.catalog_url(urls.resolve_url(F.col("url"), F.col("link"))))
    return out.groupBy("page_url", "source_url").agg(F.min_by(F.struct(*out.columns), "card").alias("r")).select("r.*")


def extract(platform: str, pages: DataFrame) -> DataFrame:
    """Records of listing pages (url, html), or of feeds (base_url, body) for ``shop_feed`` and (url, body) for ``json``."""
    if platform == "shop_feed":
        return feeds.shop_products(pages)
    if platform == "json":
        return feeds.harvested_products(pages)
    profile = PROFILES[platform]
    if profile.listing:
        return listing_records(profile, pages)
    return html.listing_products(pages, profile.cards, profile.card_fields, profile.needs_price)


def extract_pages(platform: str, pages: DataFrame) -> DataFrame:
    """Records of pages (url, html): a contract's details; else linked data where a page has it, else the generic details."""
    profile = PROFILES[platform]
    if profile.detail:
        return detail_records(profile, pages).withColumnRenamed("page_url", "url")
    nodes = html.elements(pages)
    linked = feeds.linked_data_products(html.embedded_json(nodes))
    rest = pages.join(linked.select("url").distinct(), "url", "left_anti")
    detail = html.detail_products(rest, profile.detail_fields).withColumnRenamed("page_url", "url")
    return linked.unionByName(detail, allowMissingColumns=True)
