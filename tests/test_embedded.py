"""Products in pages' scripts and images of products, page by page as they are written in shops."""

import json

from pyspark.sql import functions as F

from shelfspark.sources import embedded

URL = "https://www.shop.example/p/kit_123251"


def records(spark, html, sku="123251"):
    return embedded.embedded_records(spark.createDataFrame([(URL, html)], "url string, html string"), F.lit(sku)).collect()


def images(spark, html, sku="123251"):
    rows = embedded.product_images(spark.createDataFrame([(URL, html)], "url string, html string"), F.lit(sku)).collect()
    return rows[0].image_urls


def script(*values):
    return "".join(f'<script type="application/json">{json.dumps(v, ensure_ascii=False)}</script>' for v in values)


def test_the_code_of_the_page_counts_before_other_products(spark):
    html = """<main class="aFichaProducto"><img src="https://f.example/recursos/ayala-ecommerce-topbar-1.jpg">
      <div class="imagenes"><img src="https://f.example/recursos/topbar-1.jpg">
        <a href="/imagenes/productos/1-visible.jpg"><img src="/imagenes/productos/1-thumb.jpg" data-zoom-image="/imagenes/productos/1-zoom.jpg"></a>
        <img data-src="/imagenes/productos/1-galeria.webp"><img src="/imagenes/logo-shop.png"><img src="/imagenes/placeholder.png"><a class="menu" href="/x.jpg">x</a></div>
      <section class="productosRelacionados"><div class="imagenes"><img src="/imagenes/productos/other.jpg"></div></section></main>"""
    other = {"producto": {"codigo": "999999", "nombre": "OTHER", "img": "/imagenes/productos/9.jpg"}, "precioMonto": 999, "tieneStock": True}
    own = {"producto": {"codigo": "123251", "nombre": "KIT", "img": {"principal": "%2Fimagenes%2Fproductos%2F1-main.jpg"}, "imagenes": [{"url": "\\/imagenes\\/productos\\/1-extra.jpg"}]}, "precioMonto": 1643, "moneda": {"cod": "USD"}, "tieneStock": False}
    (row,) = records(spark, html + script(other, own))
    assert (row.sku, row.product_name, row.price, row.currency, row.availability) == ("123251", "KIT", "1643", "USD", "out_of_stock")
    at = "https://www.shop.example/imagenes/productos/"
    assert row.image_urls == [at + x for x in ("1-main.jpg", "1-extra.jpg", "1-zoom.jpg", "1-thumb.jpg", "1-galeria.webp", "1-visible.jpg")]


def test_the_complete_object_goes_over_the_short_one(spark):
    short = {"producto": {"codigo": "123251", "marca": "M", "nombre": "short"}, "precioMonto": 1}
    whole = {"producto": {"codigo": "123251", "nombre": "whole"}, "variantes": {"codigo": "123251", "img": "//f.example/c/123251_1/p.jpg"}, "precioMonto": 2, "tieneStock": None}
    for values in ((short, whole), (whole, short)):
        (row,) = records(spark, script(*values))
        assert (row.product_name, row.brand, row.price, row.image_urls, row.availability) == ("whole", "M", "2", ["https://f.example/c/123251_1/p.jpg"], None)


def test_images_of_the_variant_of_the_code(spark):
    value = {"producto": {"codigo": "123251", "nombre": "N"}, "variaciones": [{"sku": "77", "img": "/a/77.jpg"}, {"nested": {"codigoCompleto": "X123251", "foto": ["/a/1.png?x=1", 5], "url": "/catalogo/123251"}}], "moneda": {"cod": "UYU"}}
    assert images(spark, script(value)) == ["https://www.shop.example/a/1.png?x=1"]
    assert images(spark, script(value), "000") == []
    assert images(spark, script({**value, "producto": {"nombre": "N"}}), "000") == ["https://www.shop.example/a/77.jpg", "https://www.shop.example/a/1.png?x=1"]


def test_where_products_are_found(spark):
    value = {"a": [{"producto": {"codigo": "123251", "nombre": "Ñandú & <b>"}, "carac": []}], "producto": "text"}
    inline = f"<script>var x = {{y: 1}}; load({json.dumps(value)}); if (a) {{ b }}</script>"
    assert [r.product_name for r in records(spark, inline)] == ["Ñandú & <b>"]
    written = json.dumps(value, ensure_ascii=False).replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    assert [r.product_name for r in records(spark, f'<div class=x id="jsonDataFicha">{written}</div>')] == ["Ñandú & <b>"]
    assert records(spark, script({"producto": {"codigo": "1"}}, {"other": 1}) + "<script>{broken</script>") == []
    assert records(spark, "") == [] and records(spark, None) == []


def test_images_of_the_head_come_first_and_once(spark):
    html = '<meta property="og:image" content="/m/a.jpg"><meta name="twitter:image" content="/m/logo.jpg"><div id="fichaProducto"><p class="fichaImagenes"><img src="/m/a.jpg"><img src="b.gif" srcset="/m/c.avif 2x, /m/d.avif"></p></div><div class="similares" data-gallery><img src="/m/e.jpg"></div>'
    assert images(spark, html) == ["https://www.shop.example/m/a.jpg", "https://www.shop.example/p/b.gif", "https://www.shop.example/m/c.avif"]


def test_addresses(spark):
    cases = {"a.jpg": "https://h.example/d/a.jpg", "/a.jpg": "https://h.example/a.jpg", "//c.example/a.jpg": "https://c.example/a.jpg", "HTTP://c.example/a b.jpg": "HTTP://c.example/a%20b.jpg", "data:image/a.jpg": None, "url('/a.png')": "https://h.example/a.png", "%zz.jpg": "https://h.example/d/%zz.jpg", "/a+b.jpg": "https://h.example/a+b.jpg", "": None, "/a.html": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: (r.x[0] if r.x else None) for r in df.select("v", embedded.image_addresses(F.array("v"), F.lit("https://h.example/d/e?q=/x/")).alias("x")).collect()}
    assert got == cases
