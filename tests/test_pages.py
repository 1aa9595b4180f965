"""Page contracts, compatibility, pagination and the rules around them, on pages of our own."""

from pyspark.sql import functions as F

from shelfspark.functions import price
from shelfspark.operators import brands, crawl, dedupe, quality
from shelfspark.operators.rules import SiteRule
from shelfspark.plans import catalog_run
from shelfspark.schema import ORDER, conform
from shelfspark.sources import compatibility, html, profiles


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def test_info_cards(spark):
    page = """<a href="/product/bomba?utm_source=x"><div class="product-item-container"><h3 class="product-info-title">Bomba de agua Código 123 resto</h3>
      <div class="product-info-price"><span class="woocommerce-Price-currency">$ 1.290</span></div><p>Para motor</p><img src="/a.jpg" data-src="/b.jpg"><i>Disponible</i></div></a>
      <div class="product-item-container"><a href="/product/filtro">Filtro</a><span class="price-number">Consulte</span><b>US$ 12,50</b> Agotado</div>
      <div class="product-item-container"><a href="/product/filtro">Again</a><span class="price-number">$ 9</span></div>
      <div class="product-item-container"><a href="/product/bare">No marks</a> $ 5</div>
      <div class="product-item-container"><a href="/product-category/x">Kind</a><span class="price-number">$ 5</span></div>"""
    got = profiles.extract("info_cards", pages(spark, ("https://i.example/l", page), ("https://i.example/l2", page), (None, None)))
    one = found(got.where("page_url = 'https://i.example/l'"), "source_url", "product_name", "price", "currency", "availability", "description")
    assert one == [
        ("https://i.example/product/bomba", "Bomba de agua", "1.290", "UYU", "in_stock", "Para motor"),
        ("https://i.example/product/filtro", "Filtro", "12,50", "USD", "out_of_stock", None),
    ]
    assert got.count() == 4 and got.where("product_name = 'Bomba de agua'").first().image_urls == ["/a.jpg", "/b.jpg"]


def test_wrapper_and_item_cards(spark):
    page = """<div class="single-product-wrapper"><h3><a href="/articulos/mostrar/7">Espejo</a></h3><div class="product-price">$U 2.000</div><p class="product-description">Lado izquierdo</p><img src="e.png"></div>
      <div class="single-product-wrapper"><h3><a href="/articulos/mostrar/8">Inicio</a></h3><div class="product-price">$ 1</div></div>
      <div class="single-product-wrapper"><h3><a href="/articulos/mostrar/9">Sin precio</a></h3></div>
      <div class="product-item"><div class="pi-text"><a href="/es/product/5"><h5>Faro</h5></a></div><div class="product-price">USD 30</div><p class="catagory-name">Luces</p><img data-src="/f.png" src="/x.gif"></div>"""
    df = pages(spark, ("https://w.example/c/", page))
    got = profiles.extract("wrapper_cards", df)
    assert found(got, "source_url", "product_name", "price", "description", "image_url") == [("https://w.example/articulos/mostrar/7", "Espejo", "2.000", "Lado izquierdo", "https://w.example/c/e.png")]
    got = profiles.extract("item_cards", df)
    assert found(got, "source_url", "product_name", "price", "category", "availability", "image_url") == [("https://w.example/es/product/5", "Faro", "30", "Luces", "in_stock", "https://w.example/f.png")]


def test_article_cards_and_stock_articles(spark):
    page = """<article class="card__producto--item"><h3><a href="/p/1">Pastilla</a></h3><div class="card__producto--item--info--tools--pie"><h4>$ 990</h4></div>
        <div class="card__producto--item--info--titulo--modelos--linea--marcas"><h5>Fiat</h5><h5>Ford</h5><h5>Fiat</h5></div></article>
      <article class="card__producto--item"><h3><a href="/p/2">Ver modelos</a></h3><h4>$ 1</h4></article>
      <article class="card__producto--item"><h3><a href="/p/3">Sin</a></h3><h4>Consultar</h4></article>
      <article class="prod_item prod_sin_stock"><a href="/catalogo/a/pieza-x12345"><span itemprop="name">Pieza</span></a><div class="copete_f">Kia - usado</div></article>
      <article class="prod_item"><a href="/catalogo/a/otra"><span itemprop="name">Otra</span></a><span itemprop="price" content="1500"></span><i class="codigo">Código: ab123456</i><b class="enstock">En stock</b></article>
      <article class="prod_item"><a href="/catalogo/a/menu"><span itemprop="name">Ver más</span></a></article>"""
    df = pages(spark, ("https://s.example/", page))
    got = profiles.extract("article_cards", df)
    assert found(got, "source_url", "product_name", "price", "compatible_brands", "availability") == [("https://s.example/p/1", "Pastilla", "990", ["Fiat", "Ford"], None)]
    got = profiles.extract("stock_articles", df)
    assert found(got, "product_name", "price", "brand", "sku", "availability") == [("Otra", "1500", None, "AB123456", "in_stock"), ("Pieza", None, "Kia", "X12345", "out_of_stock")]


def test_detail_contracts(spark):
    info = '<body><h1 class="product_title">Bomba</h1><div class="product-info-price"><span class="price-number">$ 2.427,92</span></div><div class="brand">Kia | Corea</div><div id="tab-description">Nueva</div><figure><img src="/i.jpg"></figure><form><button>Comprar</button></form></body>'
    gone = "<body><h1>Bomba</h1><p>Página no encontrada</p></body>"
    got = profiles.extract_pages("info_cards", pages(spark, ("https://d.example/product/1", info), ("https://d.example/product/2", gone), ("https://d.example/other/1", info)))
    assert found(got, "url", "product_name", "price", "brand", "description", "availability", "image_url") == [("https://d.example/product/1", "Bomba", "2.427,92", "Kia", "Nueva", "in_stock", "https://d.example/i.jpg")]
    stock = '<h1 class="nombre">Pieza</h1><span id="precio_ent_actual" content="77">sin dato</span><div class="copete_ficha">Fiat - Uno</div><div id="producto_agotado">Agotado</div><i class="sku">SKU: Z99887</i>'
    got = profiles.extract_pages("stock_articles", pages(spark, ("https://d.example/catalogo/a/p", stock), ("https://d.example/catalogo", stock)))
    assert found(got, "product_name", "price", "brand", "sku", "availability") == [("Pieza", "77", "Fiat", "Z99887", "out_of_stock")]
    ref = '<h1 class="product_title">Junta</h1><span class="price">...</span><img class="wp-post-image" data-lazy-src="/lazy.jpg" src="/p.gif"><div class="summary"><p>Corta</p></div>'
    got = profiles.extract_pages("reference_pages", pages(spark, ("https://d.example/junta-ref-9", ref), ("https://d.example/junta", ref)))
    assert found(got, "product_name", "price", "description", "image_url") == [("Junta", None, "Corta", "https://d.example/lazy.jpg")]


def test_anchored_cards_climb(spark):
    page = '<div><section><div><div><a href="/p/1">Uno</a></div><span>$ 10</span></div><div><a href="/p/2">Dos</a><i>USD 20</i></div></section></div><p><a href="/about">x</a></p>'
    got = profiles.anchored_records(pages(spark, ("https://c.example/", page)), "/p/")
    assert found(got, "source_url", "product_name", "price") == [("https://c.example/p/1", "Uno", "10"), ("https://c.example/p/2", "Dos", "20")]


def test_pages_do_not_mix(spark):
    card = '<div class="product-item"><a href="/p/{0}">L</a><h3>N{0}</h3><span class="price">$ {0}</span></div>'
    df = pages(spark, ("https://m.example/", card.format(1)), ("https://m.example/", card.format(2)), (None, card.format(3)))
    assert found(html.listing_products(df, ".product-item"), "product_name", "price") == [("N1", "1"), ("N2", "2")]
    long = "<div><h1>Long</h1><div itemprop='description'>" + "word " * 4000 + "</div></div>"
    assert len(html.detail_products(pages(spark, ("https://m.example/d", long))).first().description) == 19_999
    fragment = "<p>first</p><h1>Second</h1><span class='price'>$ 3</span>"
    assert found(html.detail_products(pages(spark, ("https://m.example/f", fragment))), "product_name", "price") == [("Second", "3")]


def test_selectors(spark):
    page = "<ul><li class='a'><b>1</b></li><li><b>2</b></li></ul><div id='d'><ul><li><b>3</b></li></ul></div>"
    df = html.parse(pages(spark, ("u", page)))
    texts = lambda s: df.select(F.transform(html.select(s), html.text_of).alias("t")).first().t
    assert texts("li b") == ["1", "2", "3"] and texts(".a b") == ["1"] and texts("div li b") == ["3"] and texts("ul ul") == []
    assert texts("#d b, .a b, .a b") == ["1", "3"] and texts("ul") == ["1 2", "3"]


COMPATIBLE = {
    "rows": ("<table><tr><td data-label='Marca'>Fiat</td><td data-label='Modelo'>Uno</td><td data-label='Motor Año'>1.3 2010</td></tr><tr><td>x</td></tr></table>", (["Fiat - Uno - 1.3 2010"], ["Fiat"], ["Uno"], ["1.3 2010"])),
    "tables": ("<div class='table_obs'><table><thead><tr><th>Modelo</th><th>Marca</th></tr></thead><tbody><tr><td>Gol</td><td>VW</td></tr><tr><td>Up</td></tr></tbody></table></div>", (["VW - Gol"], ["VW"], ["Gol", "Up"], None)),
    "items": ("<div class='blkCaracteristicas'><div class='it'><span class='tit'>Modelos</span><span class='val'>Corsa, Astra; buscar</span></div><div class='it'>Compatibilidad Opel | Chevrolet</div></div>", (None, ["Opel", "Chevrolet"], ["Corsa", "Astra"], None)),
    "paragraphs": ("<div class='item-texto'><p>Marca: Kia</p><p>Modelos: Rio, Cerato</p><p>Otra cosa</p><p>Marca: BYD</p><p>Modelo: F3</p></div>", (["Kia - Rio", "Kia - Cerato", "BYD - F3"], ["Kia", "BYD"], ["Rio", "Cerato", "F3"], None)),
    "groups": ("<div class='ty-product-feature-group'><h3 class='ty-subheader'>Modelo</h3><div class='ty-product-feature'><span class='ty-product-feature__label'>Ford:</span><ul><li class='ty-product-feature__multiple-item'>Ka</li><li class='ty-product-feature__multiple-item'>Fiesta</li></ul></div></div>", (["Ford - Ka", "Ford - Fiesta"], ["Ford"], ["Ka", "Fiesta"], None)),
    "sections": ("<div class='producto__info--modelos'><h3>Modelos compatibles:</h3><div class='producto__info--modelos--linea'><h4>Audi:</h4><h5>A3, A4</h5></div></div>", (["Audi - A3", "Audi - A4"], ["Audi"], ["A3", "A4"], None)),
    "marked": ("<div class='compat-list'><ul><li>Seat Ibiza</li><li>Compatibilidad:</li></ul></div><div id='version-box'>Version: 1.6, 2.0</div><a class='block' href='/showmod?x'>Golf</a>", (["Seat Ibiza"], None, ["Golf"], ["1.6", "2.0", "Golf"])),
    "nothing": ("<p>Bomba</p>", (None, None, None, None)),
}


def test_compatibility(spark):
    got = compatibility.compatibility(pages(spark, *((k, page) for k, (page, _) in COMPATIBLE.items()), ("null", None)))
    lists = {r.url: tuple(r[c] for c in compatibility.LISTS) for r in got.collect()}
    for k, (_, want) in COMPATIBLE.items():
        assert lists[k] == want, k
    assert lists["null"] == (None,) * 4


def test_pagination(spark):
    page = '<ul class="pagination"><li class="active"><span>2</span></li><li><a data-ci-pagination-page="3" href="/l/3">3</a></li><li><a data-ci-pagination-page="4" href="/l/4">4</a></li><li><a href="/l/9">»</a></li></ul><div class="aListProductos" data-tot="24" data-totabs="437"></div>'
    rel = '<link rel="next" href="/l?page=5"><ul class="pagination"><a rel="next" href="/n">n</a></ul>'
    df = pages(spark, ("https://p.example/l", page), ("https://p.example/r", rel), ("https://p.example/none", None))
    assert found(crawl.page_summary(df), "url", "current_page", "next_url", "last_url") == [("https://p.example/l", 2, "https://p.example/l/3", "https://p.example/l/9"), ("https://p.example/none", None, None, None), ("https://p.example/r", None, "https://p.example/n", None)]
    assert found(crawl.next_link(df), "next_url") == [("https://p.example/l?page=5",), (None,), (None,)]
    assert found(crawl.declared_pages(df), "page_items", "total_results", "n_pages") == [(24, 437, 19)]
    rows = spark.createDataFrame([("https://p.example/l", 1), ("https://p.example/l?a=1", 2), ("https://p.example/l?page=3&b=2", 3), ("u", 9)], "u string, n int")
    assert [r.x for r in rows.select(crawl.next_by_parameter(F.col("u"), F.col("n"), max_pages=5).alias("x")).collect()] == ["https://p.example/l?page=2", "https://p.example/l?a=1&page=3", "https://p.example/l?page=4&b=2", None]


def test_site_prices(spark):
    df = spark.createDataFrame([("$U 1.290",), ("1.290,50",), ("12,5",), ("1290",), ("12.50",), ("US$ 2.716",), ("1,290.50",), ("gratis",), (None,)], "p string")
    got = df.select(price.dotted_price(F.col("p")).alias("a"), price.portal_price(F.col("p")).alias("b")).collect()
    assert [r.a for r in got] == ["1290", "1290.50", "12.5", "1290", "12.50", "2716", "1,290.50", None, None]
    assert [r.b for r in got] == ["1290", "1290.50", "12.5", "1290", "12.50", "2716", "1.290.50", None, None]


def test_controls_and_challenges(spark):
    df = spark.createDataFrame([("Ordenar por", "x", "https://a.example/p"), ("Bomba", "12 productos más", "https://a.example/p"), ("Bomba", "x", "https://a.example/l?sort_by=1"), ("Bomba", "Bomba $ 1", "https://a.example/p/1"), (None, None, None)], "n string, t string, u string")
    assert [r.x for r in df.select(quality.control(F.col("n"), F.col("t"), F.col("u")).alias("x")).collect()] == [True, True, True, False, False]
    body = spark.createDataFrame([("<p>Just a moment...</p>",), ("<p>Bomba</p>",), (None,)], "b string")
    assert [r.x for r in body.select(quality.challenge(F.col("b")).alias("x")).collect()] == [True, False, False]
    rule = SiteRule("a", ("a.example",), product_patterns=("/p/",))
    rows = spark.createDataFrame([("https://a.example/p/1", None, None, "", 1), ("https://a.example/x", "T", "9", "", 0), ("https://a.example/x", "T", None, "agregar al carrito", 0), ("https://a.example/x", "T", None, "nada", 0), ("https://a.example/p/1", "T", "9", "", 5)], "u string, t string, p string, w string, n int")
    assert [r.x for r in rows.select(quality.likely_detail(F.col("u"), F.col("t"), F.col("p"), F.col("w"), rule, F.col("n")).alias("x")).collect()] == [True, True, True, False, False]
    state = spark.createDataFrame([("https://schema.org/OutOfStock", ["instock"], "", True), (None, ["outofstock"], "", True), (None, [], "Leer más", False), (None, [], "5 disponibles", False), (None, [], "nada", False), (None, [], "nada", True)], "e string, c array<string>, t string, b boolean")
    assert [r.x for r in state.select(quality.stock_state(F.col("e"), F.col("c"), F.col("t"), F.col("b")).alias("x")).collect()] == ["out_of_stock", "out_of_stock", "out_of_stock", "in_stock", None, "in_stock"]


def test_two_keys_are_one_product(spark):
    rows = [(1, "u1", "S1", "A"), (2, "u2", "s1", "B"), (3, "u2", None, "C"), (4, None, "S1", "D"), (5, None, "S9", "E"), (6, "u3", "S3", "F")]
    df = conform(spark.createDataFrame([("x", *r) for r in rows], f"site string, {ORDER} long, source_url string, sku string, product_name string"))
    merged, counts = dedupe.merge_two_keys(df, "site")
    assert found(merged, "source_url", "product_name") == [("u1", "D"), ("u2", "C"), ("u3", "F")]
    assert found(counts, "n_records", "n_duplicates") == [(5, 2)]


def test_lexicon_and_references(spark):
    df = spark.createDataFrame([("Bujía Citroën-Peugeot CH 1.6 Saxo",), (None,)], "t string")
    got = df.select(brands.lexicon_matches(F.col("t"), ["Citroen", "Peugeot", "Sax", "Kia"], {"Chevrolet": r"\bch\b"}).alias("x")).collect()
    assert got[0].x == ["Citroen", "Peugeot", "Sax", "Chevrolet"] and got[1].x == []
    df = spark.createDataFrame([("ver 12345-AB y 9988/7 12345-AB",), ("sin codigo",), ("x" * 300,)], "t string")
    assert [r.x for r in df.select(brands.references(F.col("t")).alias("x")).collect()] == ["12345-AB / 9988/7", "sin codigo", None]


def test_a_run_keeps_the_order_of_arrival(spark):
    """The value that arrives last wins, and the first place stays: listing, page, position."""
    rule = SiteRule("n", ("n.example",), product_patterns=("/product/",))
    listings = spark.createDataFrame([("A", 1, "https://n.example/a", "".join(f'<a href="/product/{i}">p</a>' for i in (5, 3, 9)))], "listing_url string, page int, url string, html string")
    page = "<html><script type='application/ld+json'>{{\"@type\":\"Product\",\"name\":\"Bomba {0}\",\"url\":\"https://n.example/product/one\",\"offers\":{{\"price\":\"{0}\",\"availability\":\"InStock\"}}}}</script></html>"
    details = spark.createDataFrame([(f"https://n.example/product/{i}", page.format(i)) for i in (3, 5, 9)], "url string, html string")
    out = catalog_run.run(listings, details, rule)
    assert [(r.product_name, r.price) for r in out.products.collect()] == [("Bomba 9", "9")]
    assert out.duplicates.count() == 2
