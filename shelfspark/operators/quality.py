"""Quality of product records: availability, warnings, the gate and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, price, urls
from ..functions.text import clean_text, fold, let, plain
from .rules import SiteRule, any_match

# Texts, names, patterns and codes that results depend on.
NEGATIVE_TEXTS = ("agotado", "sin stock", "out of stock", "no disponible")
POSITIVE_TEXTS = ("en stock", "disponible", "agregar al carrito", "anadir al carrito", "comprar")
INVALID_NAMES = ("productos", "inicio", "home", "404", "pagina no encontrada", "finalizar compra", "ver mas", "ver más", "comprar")
INVALID_NAME_PATTERNS = ("^ordenar por$", "^total productos(?:\\s+\\d+)?$", "^mostrar(?:\\s+\\d+)?$", "^filtros?$", "^resultados?$", "^compartir$", "^whatsapp$", "^facebook$", "^instagram$", "^telegram$", "^buscar$", "^ver mas(?: productos)?$", "^categoria(?:s)?$")
AUTOMOTIVE_WORDS = (
    "autopartes? automotriz automotor veh[ii]culo?s? auto?s? coches? camioneta?s? moto?s? carrocer[ii]a paragolpe parachoque faro farol optica luz espejo retrovisor guardabarro cap[oó]t parrilla moldura emblema insignia manija "
    "cerradura parabrisas cristal vidrio filtro aceite lubricaci[oó]n bomba inyector radiador motor embrague freno disco pastilla amortiguador suspensi[oó]n buje rodam terminal rotula homocinet cardan correa bujia bobina alternador "
    "arranque sensor arn[eé]s cable llanta neumatic cubierta escape silenciador catalizador bateria refrigeraci[oó]n climatizaci[oó]n accesorios? broche clip grapa tornillo tuerca abrazadera soporte carcasa tapa valvula transmision cambio direccion traccion"
)
NAME_WORDS = "repuesto repuestos"
BRAND_WORDS = ("fiat", "ford", "toyota", "nissan", "volkswagen", "vw", "renault", "peugeot", "citroen", "chevrolet", "gmc", "gm", "hyundai", "kia", "mazda", "mitsubishi", "suzuki", "bmw", "mercedes", "audi", "volvo", "chery", "geely", "byd", "honda", "subaru", "isuzu", "jeep", "ram", "dodge", "chrysler", "opel", "seat", "skoda", "land rover", "mini")
BLOCKED_HOSTS = ("wa.me", "whatsapp.com", "facebook.com", "instagram.com", "messenger.com", "telegram.me", "t.me", "youtube.com", "x.com", "twitter.com")
BLOCKED_PATHS = ("[?&]dispatch=product_features\\.add_product(?:&|$)", "/share", "/sharer", "/send", "/intent", "/login", "/logout", "/checkout", "/carrito", "/cart", "/mi-cuenta", "/contacto", "/buscar(?:[/?#]|$)", "/search(?:[/?#]|$)", "/sitemap", "/rss", "/order", "/sort")
PRODUCT_WORDS = ("producto", "productos", "repuesto", "repuestos", "catalogo", "product", "shop", "detalle", "articulo", "articulos")
HARD_WARNINGS = ("invalid_name", "external_url", "invalid_product_url", "non_automotive", "invalid_page")
LONGEST_DESCRIPTION = 1200


def availability(text: Column, rule: SiteRule | None = None) -> Column:
    """``out_of_stock``, ``in_stock`` or ``unknown``; negative texts are looked for first."""
    # The texts are folded here, in Python, as ``fold`` would.
    has = lambda folded, texts: F.exists(F.array(*(F.lit(plain(t)) for t in texts)), lambda t: F.contains(folded, t))
    negative = (*NEGATIVE_TEXTS, *(rule.negative_texts if rule else ()))
    positive = (*POSITIVE_TEXTS, *(rule.positive_texts if rule else ()))
    return let(fold(text), lambda t: F.when(has(t, negative), "out_of_stock").when(has(t, positive), "in_stock").otherwise("unknown"))


def sellable(rule: SiteRule | None = None, amount: Column | None = None) -> Column:
    """A name, a page, a positive price; then a numeric stock decides, then the availability, then all texts.

    ``amount`` is the parsed price, where it is known already.
    """
    known = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    stock = F.replace(F.col("stock"), F.lit(","), F.lit(".")).try_cast("double")
    state = F.lower(F.coalesce("availability", F.lit("")))
    texts = F.concat_ws(" ", "availability", "description", "product_name")
    decided = (
        F.when(known("stock") & stock.isNotNull() & ~F.isnan(stock), stock > 0)
        .when(F.contains(state, F.lit("out_of_stock")), False)
        .when(F.contains(state, F.lit("in_stock")), True)
        .otherwise(availability(texts, rule) == "in_stock")
    )
    positive = F.coalesce(price.parse_price(F.col("price")) if amount is None else amount, F.lit(0.0)) > 0
    return known("product_name") & known("source_url") & positive & decided


def blocked(url: Column) -> Column:
    """Pages of messengers and networks, carts, logins, searches and the like; what is no http address too."""
    host = F.regexp_extract(F.lower(url), "^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    hosts = "|".join(h.replace(".", "\\.") for h in BLOCKED_HOSTS)
    where = F.concat(urls.path_of(url), urls.query_of(url))
    return ~urls.is_http(url) | host.rlike(f"(?:^|\\.)(?:{hosts})$") | where.rlike("|".join(BLOCKED_PATHS))


def allowed(url: Column, base: Column | None = None) -> Column:
    """Not blocked, and on the host of ``base``."""
    ok = ~blocked(url)
    return ok if base is None else ok & F.coalesce(urls.hostname(url) == urls.hostname(base), F.lit(False))


def external(url: Column, rule: SiteRule | None) -> Column:
    if rule is None or not rule.hosts:
        return F.lit(False)
    return ~F.coalesce(urls.hostname(url).isin(list(rule.hosts)), F.lit(False))


def product_like(url: Column, rule: SiteRule) -> Column:
    """A pattern of the rule, or a usual word for products (unless the rule's paths are strict)."""
    found = any_match(url, rule.product_patterns)
    return found if rule.strict_paths else found | F.lower(url).rlike("|".join(PRODUCT_WORDS))


def specific_product(url: Column, rule: SiteRule | None = None) -> Column:
    """Whether the address by its shape is one product's page."""

    def shaped(parts: Column) -> Column:
        n, first, last = F.size(parts), F.get(parts, F.lit(0)), F.element_at(F.concat(F.array(F.lit("")), parts), -1)
        return (
            F.when(n == 0, False)
            .when(first.rlike("product|producto|productos|articulo|articulos|detalle|mostrar|item|sku"), n >= 2)
            .when(first.rlike("catalogo|repuestos?"), n >= 3)
            .when(first.rlike("product-category|categoria|category|shop|ofertas|outlet"), False)
            .when(urls.query_of(url).rlike("[?&](?:codigo|sku|id|producto)(?:=|&|$)"), True)
            .otherwise((n >= 2) & last.rlike("[-\\d]"))
        )

    found = let(F.filter(F.split(urls.path_of(url), "/"), lambda x: x != ""), shaped)
    return any_match(url, rule.product_patterns if rule else ()) | F.coalesce(urls.is_http(url) & found, F.lit(False))


def automotive(rule: SiteRule | None = None) -> Column:
    """Signs of car parts in the texts, else in the path, else a product's own page."""
    words = lambda *groups: "\\b(?:" + "|".join(w for g in groups for w in (g.split() if isinstance(g, str) else g)) + ")\\b"
    texts = F.concat_ws(" ", *("product_name", "brand", "category", "description"), arrays.list_text(F.col("compatible_vehicles")), arrays.list_text(F.col("compatible_brands")), arrays.list_text(F.col("shipping_info")), arrays.map_text(F.col("attributes")))
    url = clean_text(F.col("source_url"))
    by_path = F.coalesce(fold(urls.path_of(url)).rlike(words(AUTOMOTIVE_WORDS, BRAND_WORDS)), F.lit(False))
    by_shape = F.lit(False) if rule and rule.strict_paths else F.coalesce(specific_product(url, rule), F.lit(False))
    return fold(texts).rlike(words(NAME_WORDS, AUTOMOTIVE_WORDS, BRAND_WORDS)) | by_path | by_shape


def warnings(rule: SiteRule | None = None) -> Column:
    """Codes in their fixed order; at most one of the three on the address. What several codes use is computed once."""
    code = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))
    url = F.col("source_url")
    shape = ~product_like(url, rule) if rule and rule.product_patterns else F.lit(False)
    wrong = lambda name: F.lower(name).isin(list(INVALID_NAMES)) | fold(name).isin(list(INVALID_NAMES)) | name.rlike("(?i)" + "|".join(INVALID_NAME_PATTERNS))

    def codes(of: Column) -> Column:
        name, amount, number = of["name"], of["amount"], of["number"]
        return F.array_compact(
            F.array(
                code(name.isNull(), "missing_name"),
                code(amount.isNull(), "missing_price"),
                code(wrong(name), "invalid_name"),
                code(amount.isNotNull() & (F.coalesce(number, F.lit(0.0)) <= 0), "invalid_price"),
                F.when(url.isNull() | (url == ""), "missing_url").when(external(url, rule) | blocked(url), "external_url").when(shape, "invalid_product_url"),
                code(~automotive(rule), "non_automotive"),
                code(F.length("description") > LONGEST_DESCRIPTION, "noisy_description"),
                code(~sellable(rule, number), "not_sellable"),
            )
        )

    parsed = let(price.normalize_price(F.col("price")), lambda amount: F.struct(clean_text(F.col("product_name")).alias("name"), amount.alias("amount"), price.parse_amount(amount).alias("number")))
    return let(parsed, codes)


def annotate(products: DataFrame, rule: SiteRule | None = None) -> DataFrame:
    """``products`` with their warnings.

    These come out of a generator of one entry: no later filter is pushed below it, where it
    would compute them again.
    """
    once = F.explode_outer(F.array(warnings(rule))).alias("quality_warnings")
    names = products.columns if "quality_warnings" in products.columns else [*products.columns, "quality_warnings"]
    return products.select(*(once if c == "quality_warnings" else F.col(c) for c in names))


def gate(products: DataFrame, rule: SiteRule | None = None) -> DataFrame:
    """Annotated products without those of a hard warning; what is out of stock goes only where the rule says so."""
    kept = annotate(products, rule).where(~F.arrays_overlap("quality_warnings", F.array(*map(F.lit, HARD_WARNINGS))))
    if rule is not None and not rule.keep_out_of_stock:
        texts = F.concat_ws(" ", "availability", "description")
        kept = kept.where((F.lower(F.coalesce("availability", F.lit(""))) != "out_of_stock") & (availability(texts, rule) != "out_of_stock"))
    return kept


def warning_counts(products: DataFrame) -> DataFrame:
    """(warning, n): in how many records each code stands."""
    return products.select(F.explode_outer("quality_warnings").alias("warning")).where("warning is not null").groupBy("warning").agg(F.count("*").alias("n"))


def placeholder_image(image: Column) -> Column:
    return F.coalesce(F.lower(image).rlike("placeholder|logo|no[-_ ]?image|sin[-_ ]?imagen|default|favicon"), F.lit(False))


def valid_image(image: Column) -> Column:
    """An http address of a picture that is no placeholder."""
    return urls.is_http(image) & ~placeholder_image(image) & F.coalesce(urls.path_of(image).rlike("\\.(?:jpe?g|png|webp|gif|avif)$"), F.lit(False))


# Texts of controls, addresses of sorted or filtered lists, and what pages say that stand before the real one.
CONTROL_TEXT = "^(?:ordenar por|total productos(?:\\s+\\d+)?|mostrar(?:\\s+\\d+)?|ver mas|ver mas productos|filtros?|resultados|categoria(?:s)?|pagina(?:\\s+\\d+)?)$|^\\d+\\s+productos?\\s+mas$|^productos?\\s+mas$|^\\d+\\s+mas$"
CONTROL_URL = "sort(?:_|-)?by|orderby|filter|filters|pagination|page-\\d+"
CHALLENGE_TEXT = "cloudflare|access denied|forbidden|captcha|verify you are human|just a moment|security check|anti bot|robot"
DETAIL_SIGNS = "comprar|agregar al carrito|consultar|en stock|agotado|sin stock|disponible|iva inc|producto|repuesto|articulo|ficha"


def control(name: Column, card_text: Column, url: Column) -> Column:
    """Whether a card is a control of the page (sorting, paging, a filter) and no product."""
    return F.coalesce(fold(name).rlike(CONTROL_TEXT) | fold(card_text).rlike(CONTROL_TEXT) | F.lower(url).rlike(CONTROL_URL), F.lit(False))


def challenge(body: Column) -> Column:
    """Whether a page only asks its reader to prove something."""
    return fold(clean_text(body)).rlike(CHALLENGE_TEXT)


def likely_detail(url: Column, title: Column, amount: Column, page_text: Column, rule: SiteRule, product_links: Column | None = None, is_listing: Column | None = None) -> Column:
    """Whether a page is one product's: its address fits, or it has a title and a price or words of one.

    A page that has marks of a listing, or more than one link to products, is none.
    """
    one = (F.coalesce(product_links, F.lit(0)) <= 1) if product_links is not None else F.lit(True)
    listing = F.coalesce(is_listing, F.lit(False)) if is_listing is not None else F.lit(False)
    signs = title.isNotNull() & (amount.isNotNull() | fold(page_text).rlike(DETAIL_SIGNS))
    return one & ~listing & (any_match(url, rule.product_patterns) | F.coalesce(signs, F.lit(False)))


def stock_state(explicit: Column, classes: Column, text: Column, has_button: Column) -> Column:
    """Availability by what is stated, else by class and text, else by a button to buy; null if nothing says."""
    words = fold(F.concat_ws(" ", text, F.array_join(classes, " ")))
    in_class = lambda c: F.contains(F.array_join(classes, " "), F.lit(c))
    return (
        F.when(F.lower(explicit).contains("outofstock"), "out_of_stock")
        .when(F.lower(explicit).contains("instock"), "in_stock")
        .when(in_class("outofstock") | words.rlike("agotado") | (words.rlike("leer mas") & ~has_button), "out_of_stock")
        .when(in_class("instock") | has_button | words.rlike("anadir al carrito|\\d+\\s+disponibles?"), "in_stock")
    )
