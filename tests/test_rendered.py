from shelfspark.sources import rendered

URL = "https://r.example/p/filtro"


def rows(spark, html):
    return sorted(rendered.rendered_records(spark.createDataFrame([(URL, html)], "url string, html string")).collect(), key=lambda r: (r.kind, r.place))


def test_cards_around_links(spark):
    filler = "texto largo " * 100
    html = f"""<body><nav><a href="/contacto">Contacto y ventas</a><a href="/menu">Lista</a></nav>
      <div class="card"><a href="/p/1"><img data-src="/i/1.jpg"></a><h3>Bomba Toyota</h3><p>US$ 12,50</p><p>AGOTADO</p></div>
      <div class="card"><div><a href="/p/2">Filtro Fiat vista rápida</a></div><span>$ 1.290</span><b>$ 9</b> disponible</div>
      <div>{filler}<p><a href="/p/3">Sin valor</a></p></div><a href="javascript:x">Nada $ 5</a><a href="/p/4">ver más</a></body>"""
    got = {r.source_url.rsplit("/", 1)[1]: r for r in rows(spark, html)}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].product_name, got["1"].price, got["1"].currency, got["1"].availability, got["1"].stock, got["1"].image_url, got["1"].compatible_brands) == ("Bomba Toyota", "12,50", "USD", "out_of_stock", "0", "https://r.example/i/1.jpg", ["Toyota"])
    assert (got["2"].product_name, got["2"].price, got["2"].availability, got["2"].stock) == ("Filtro Fiat", "1.290", "in_stock", None)
    assert (got["3"].product_name, got["3"].price) == ("Sin valor", None)


def test_the_page_itself_and_linked_data(spark):
    html = f"""<head><meta name="description" content="Un filtro"><script type="application/ld+json">{{"@type":"Product","name":"Linked","offers":{{"price":"7","availability":"InStock"}},"url":"{URL}","image":"/l.jpg"}}</script><script type="application/ld+json">broken</script></head>
      <body><ul class="breadcrumb"><li>Inicio</li><li>Filtros</li></ul><main><h1>Filtro de aceite Precio: $ 5</h1><p>Precio $ 1.290. Envío gratis a todo el país. Otra frase! Retiro en local.</p>
      <table><tr><th>Motor</th><td>1.6</td><td>8v</td></tr><tr><td>solo</td></tr></table> para Kia y KIA, en stock</main></body>"""
    (row,) = rows(spark, html)
    assert (row.product_name, row.price, row.category, row.description, row.source_url) == ("Filtro de aceite", "5", "Filtros", "Un filtro", URL)
    assert row.shipping_info == ["Envío gratis a todo el país.", "Retiro en local."] and row.attributes == {"Motor": "1.6 / 8v"} and row.compatible_brands == ["Kia", "KIA"]
    assert (row.availability, row.image_url, row.kind) == ("in_stock", "https://r.example/l.jpg", 0)


def test_pages_without_records(spark):
    assert rows(spark, "<p>texto</p>") == [] and rows(spark, "") == [] and rows(spark, None) == []
