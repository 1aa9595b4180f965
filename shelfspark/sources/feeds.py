"""Product feeds in JSON: known shapes by schema, unknown ones by walking all their objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, urls
from ..functions.text import clean_text, strip_tags

SHOP = "products array<struct<title:string,handle:string,body_html:string,product_type:string,vendor:string,images:array<struct<src:string>>,variants:array<struct<price:string,sku:string,available:boolean>>>>"
ITEMS = "array<struct<codigo:string,codigo_fabrica:string,descripcion_corta:string,descripcion_larga:string,comentarios:string,no_comprable:string,stock:string,precio:string,precio_anterior_con_iva:string,moneda:string,marca:string,rubro:string,subrubro:string,foto_grande:string,foto_chica:string,oferta:string,promocion:string>>"
TENANT = f"cantidad_registros string, productos {ITEMS}"


def shop_products(feeds: DataFrame, currency: str = "UYU") -> DataFrame:
    """Records of shop feeds (``feeds``: base_url, body): title, handle and price are needed; the first variant that is available counts, else the first."""
    one = feeds.select("base_url", F.posexplode(F.from_json("body", SHOP)["products"]).alias("place", "p"))
    variant = F.coalesce(F.get(F.filter("p.variants", lambda v: v["available"]), F.lit(0)), F.get("p.variants", F.lit(0)))
    rows = one.withColumn("v", variant).withColumn("root", F.regexp_extract("base_url", "^(https?://[^/?#]+)", 1))
    out = rows.select(
        "base_url", "place",
        clean_text(F.col("p.title")).alias("product_name"), price.normalize_price(F.col("v.price")).alias("price"), F.lit(currency).alias("currency"), clean_text(F.col("p.vendor")).alias("brand"),
        clean_text(F.col("v.sku")).alias("sku"), clean_text(F.col("p.product_type")).alias("category"), strip_tags(F.col("p.body_html")).alias("description"),
        urls.resolve_url(F.col("base_url"), F.get("p.images", F.lit(0))["src"]).alias("image_url"), F.concat("root", F.lit("/products/"), clean_text(F.col("p.handle"))).alias("source_url"),
        F.when(~F.col("v.available"), "out_of_stock").otherwise("in_stock").alias("availability"),
    )
    return out.where(F.col("product_name").isNotNull() & F.col("source_url").isNotNull() & F.col("price").isNotNull())


def tenant_products(feeds: DataFrame, product_url: str | None = None) -> DataFrame:
    """Records of a tenant's feed (``feeds``: source_url, body), an object with its items or a list of them; ``product_url`` is a prefix for codes."""
    listed = F.trim("body").startswith("[")
    items = F.when(listed, F.from_json("body", ITEMS)).otherwise(F.from_json("body", TENANT)["productos"])
    one = feeds.select(F.col("source_url").alias("feed_url"), F.posexplode(items).alias("place", "i"))
    text = lambda c: F.nullif(F.trim(F.col(f"i.{c}")), F.lit(""))
    stock = F.replace(F.trim(F.coalesce("i.stock", F.lit(""))), F.lit(","), F.lit("."))
    number = F.when(stock == "", 0.0).otherwise(stock.try_cast("double"))
    barred = F.coalesce(F.upper(text("no_comprable")).isin("S", "SI", "1", "TRUE"), F.lit(False))
    sku = F.coalesce(text("codigo"), text("codigo_fabrica"))
    own = F.concat(F.lit(product_url), F.url_encode(sku)) if product_url else F.lit(None).cast("string")
    category = F.nullif(F.concat_ws(" / ", text("rubro"), text("subrubro")), F.lit(""))
    images = F.array_distinct(F.array_compact(F.array(text("foto_grande"), text("foto_chica"))))
    return one.select(
        "feed_url", "place",
        F.coalesce(text("descripcion_corta"), text("descripcion_larga")).alias("product_name"), price.normalize_price(F.coalesce(text("precio"), text("precio_anterior_con_iva"))).alias("price"),
        price.infer_currency(F.lit(None).cast("string"), F.coalesce(text("moneda"), F.lit("$"))).alias("currency"), text("marca").alias("brand"), category.alias("category"),
        F.coalesce(text("descripcion_larga"), text("comentarios")).alias("description"),
        F.when(barred, "out_of_stock").when(number.isNull() | F.isnan(number), "unknown").when(number > 0, "in_stock").otherwise("out_of_stock").alias("availability"),
        F.trim("i.stock").alias("stock"), sku.alias("sku"), F.coalesce(own, F.col("feed_url")).alias("source_url"), F.get(images, F.lit(0)).alias("image_url"), images.alias("image_urls"),
    )


OBJECTS = "url string, place int, object string"


def json_objects(feeds: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, place, object): every object at any depth of a JSON text, parents first; broken texts give none."""

    def walk(value: object) -> Iterator[dict]:
        stack = [value]
        while stack:
            now = stack.pop()
            if isinstance(now, dict):
                yield now
                now = list(now.values())
            if isinstance(now, list):
                stack.extend(reversed(now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, text in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    found = [json.dumps(x) for x in walk(json.loads(text or "null"))]
                except ValueError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["url", "place", "object"])

    return feeds.select(F.col(url).alias("url"), F.col(body).alias("body")).mapInArrow(run, OBJECTS)


def _text(*names: str) -> Column:
    """The first of the fields that is a text or number and not blank."""
    return F.coalesce(*(clean_text(F.get_json_object("object", f"$.{n}")) for n in names))


def harvested_products(feeds: DataFrame) -> DataFrame:
    """Records of all objects that have a name, whatever the feed's shape."""
    available = F.get_json_object("object", "$.available")
    out = json_objects(feeds).select(
        "url", "place", _text("name", "title", "productName").alias("product_name"), price.normalize_price(_text("price", "salePrice", "amount")).alias("price"), F.coalesce(_text("currency"), F.lit("UYU")).alias("currency"),
        _text("sku", "code").alias("sku"), _text("brand").alias("brand"), _text("imageUrl", "image").alias("image_url"), F.coalesce(_text("url"), F.col("url")).alias("source_url"),
        F.when(available == "false", "out_of_stock").otherwise("in_stock").alias("availability"),
    )
    return out.where(F.col("product_name").isNotNull())


def linked_data_products(scripts: DataFrame) -> DataFrame:
    """Records of the objects of type Product in JSON-LD scripts (``scripts``: url, body), at any depth; the first offer counts."""
    # The type is a text, or a list of texts.
    kind = F.get_json_object("object", "$.@type")
    is_product = (F.lower(kind) == "product") | F.exists(F.coalesce(F.from_json(kind, "array<string>"), F.array().cast("array<string>")), lambda x: F.lower(x) == "product")
    first = lambda one, many: F.coalesce(_text(many), _text(one))
    amount = F.coalesce(first("offers.price", "offers[0].price"), _text("offers[0].priceSpecification[0].price", "offers.priceSpecification[0].price", "offers.priceSpecification.price", "price"))
    state = F.lower(F.coalesce(first("offers.availability", "offers[0].availability"), F.lit("")))
    image = F.coalesce(_text("image[0]"), _text("image"))
    out = json_objects(scripts).where(is_product).select(
        "url", "place", _text("name").alias("product_name"), price.normalize_price(amount).alias("price"), price.infer_currency(first("offers.priceCurrency", "offers[0].priceCurrency"), amount).alias("currency"),
        _text("brand.name", "brand").alias("brand"), _text("sku").alias("sku"), _text("description").alias("description"), urls.resolve_url(F.col("url"), image).alias("image_url"),
        F.coalesce(urls.resolve_url(F.col("url"), _text("url")), F.col("url")).alias("source_url"), F.when(F.contains(state, F.lit("instock")), "in_stock").when(F.contains(state, F.lit("outofstock")), "out_of_stock").alias("availability"),
    )
    return out.where(F.col("product_name").isNotNull())


def alias_record(feeds: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Objects mapped to fields by lists of names, in whichever language they are written; the first known one counts."""
    return json_objects(feeds).select("url", "place", *(_text(*names).alias(field) for field, names in aliases.items()))


def unwrap_envelope(pages: DataFrame, body: str = "body") -> DataFrame:
    """``html`` and ``total`` of answers that are a JSON envelope around markup, or the markup itself."""
    data = lambda *names: F.coalesce(*(F.get_json_object(body, f"$.{n}") for n in names))
    wrapped = F.trim(body).startswith("{")
    return pages.withColumn("html", F.when(wrapped, F.coalesce(data("d", "data"), F.lit(""))).otherwise(F.col(body))).withColumn("total", F.when(wrapped, data("cantArticulos", "number_register", "last").try_cast("bigint")))


def script_objects(scripts: DataFrame, marker: str) -> DataFrame:
    """(url, place, object): the outermost JSON objects inside script source (``scripts``: url, body) whose text holds ``marker``."""

    def balanced(text: str) -> Iterator[str]:
        decoder, at = json.JSONDecoder(), text.find("{")
        while at >= 0:
            try:
                _, end = decoder.raw_decode(text, at)
            except ValueError:
                at = text.find("{", at + 1)
                continue
            yield text[at:end]
            at = text.find("{", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, text in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
                found = [x for x in balanced(text or "") if marker in x]
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["url", "place", "object"])

    return scripts.select("url", "body").mapInArrow(run, OBJECTS)


def raw_record(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with the first price, its currency and the first vehicle brand that a text names."""
    from ..operators.brands import aliases_in

    priced = F.regexp_extract(F.col(text), r"(?i)((?:US\$|\$U|\$|UYU|USD)\s*[0-9][0-9.,]*)", 1)
    return texts.withColumns({"price": price.normalize_price(F.nullif(priced, F.lit(""))), "currency": price.infer_currency(F.lit(None).cast("string"), priced), "brand": F.get(aliases_in(F.col(text)), F.lit(0))["label"]})


def part_record(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with the part number and the price that labels in a container's text announce."""
    code = clean_text(F.regexp_extract(text, r"(?i)(?:n[º°o]\.?\s*(?:de\s*)?pieza|c[oó]digo|sku)\s*:?\s*([\w./-]+)", 1))
    amount = F.regexp_extract(text, r"(?i)precio\s*:?\s*((?:US\$|\$U|\$)?\s*[0-9][0-9.,]*)", 1)
    return texts.withColumns({"sku": code, "price": price.normalize_price(F.nullif(amount, F.lit("")))})
