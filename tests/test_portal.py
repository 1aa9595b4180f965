"""Cards of each tier, containers of details, and their records."""

from shelfspark.sources import portal

URL = "https://p.example/v2/list"


def rows(spark, html, read=portal.listing_records):
    return sorted(read(spark.createDataFrame([(URL, html)], "url string, html string")).collect(), key=lambda r: r.card)


def card(n, tag="div", extra=""):
    return f'<{tag} {extra}><a href="/v2/producto-detalle/m/YK-{n}/faro-{n}-2004"><img src="/i/{n}.jpg"></a><h3>FARO {n}</h3><span class="precio">$ 1.2{n}0</span><p>Cod. Yokomitsu: YK-{n} Marca: Fiat Modelo: Uno OEM: 12-{n}</p></{tag}>'


def test_marked_cards_come_first(spark):
    got = rows(spark, f"<div class='product-item'>Precio {card(9)}</div>" + card(1, extra='data-codprod="A1"') + card(2, extra='data-codprod="A2"') + '<div data-codprod="x">menu</div>')
    assert [(r.sku, r.product_name, r.price, r.brand, r.compatible_models, r.attributes) for r in got] == [(f"A{n}", f"FARO {n}", f"12{n}0", "Fiat", ["Uno"], {"referencia": f"12-{n}"}) for n in (1, 2)]
    assert got[0].source_url == "https://p.example/v2/producto-detalle/m/YK-1/faro-1-2004" and got[0].image_url == "https://p.example/i/1.jpg" and got[0].currency == "UYU"


def test_what_surrounds_links_to_details(spark):
    """The widest element that is still short: a list of little text is one card, one of much text has a card a link."""
    filler = "<p>" + "texto " * 600 + "</p>"
    got = rows(spark, f"<html><body><div>{card(1)}{card(2)}</div>{filler}</body></html>")
    assert len(got) == 1 and got[0].sku == "YK-1"
    got = rows(spark, f"<html><body><div>{card(1)}{filler}</div><div>{card(2)}{filler}</div></body></html>")
    assert [r.sku for r in got] == ["YK-1", "YK-2"]


def test_broad_elements_and_whole_pages(spark):
    long = "<b>" + "texto " * 600 + "</b>"
    got = rows(spark, f"<table><tr><td>{long}<a href='/v2/producto-detalle/m/1/bomba-agua'>{long}</a></td></tr><tr><td>no</td></tr></table>")
    assert [(r.product_name, r.card > 0) for r in got] == [("BOMBA AGUA", True)]
    got = rows(spark, "<div>SKU: AB-1 Producto: Correa Dentada</div>")
    assert [(r.sku, r.product_name, r.card) for r in got] == [("AB-1", "Correa Dentada", 0)]
    assert rows(spark, "<div>nada</div>") == [] and rows(spark, None) == []


def test_details_are_the_least_marked_container(spark):
    html = '<title>Faro - YOKOMITSU</title><article>menu precio<p>Faro</p></article><div class="producto-detalle"><div class="producto-detalle"><h1>FARO</h1><p class="descripcion">FARO CORSA 2004 DERECHO</p><span class="precio">US$ 20 + IVA</span> Procedencia: Brasil SKU: Z-1</div> otros productos con precio y mas texto</div>'
    (row,) = rows(spark, html, portal.detail_records)
    assert (row.product_name, row.sku, row.price, row.currency, row.attributes, row.source_url) == ("FARO CORSA 2004 DERECHO", "Z-1", "20", "USD", {"procedencia": "Brasil"}, URL)
    (row,) = rows(spark, "<h2>Bomba De Agua</h2><p>texto</p>", portal.detail_records)
    assert row.product_name == "Bomba De Agua" and row.card == 0
