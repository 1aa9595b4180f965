import datetime

from pyspark.sql import functions as F

from shelfspark.operators.rules import SiteRule
from shelfspark.plans import catalog_run
from shelfspark.schema import conform
from shelfspark.sources import feeds

RULE = SiteRule("north", ("www.north.example",), product_patterns=("/product/",))


def pages(spark):
    link = lambda *n: "".join(f'<a href="/product/{i}?utm_source=x">p</a>' for i in n)
    rows = [("A", 1, "https://north.example/a", link(1, 2)), ("A", 2, "https://north.example/a?page=2", link(2, 3)), ("A", 3, "https://north.example/a?page=3", link(3)), ("A", 4, "https://north.example/a?page=4", link(9)), ("B", 1, "https://north.example/b", link(1))]
    detail = [(f"https://north.example/product/{i}", f"<html><h1>{'Ver mas' if i == 2 else f'Bomba {i}'}</h1><span class='price'>$ {i}.290</span><p class='stock'>disponible</p></html>") for i in (1, 2, 3, 4, 9)]
    return spark.createDataFrame(rows, "listing_url string, page int, url string, html string"), spark.createDataFrame(detail, "url string, html string")


def test_run(spark):
    listings, details = pages(spark)
    stored = conform(spark.createDataFrame([], "id string, site string, created_at timestamp, updated_at timestamp, last_seen_at timestamp, search_text string"))
    out = catalog_run.run(listings, details, RULE, "run", stored=stored, run_at=F.lit(datetime.datetime(2024, 1, 1)))
    assert sorted((r.listing_url, r.page, r.new_in_listing, r.reason) for r in out.pages.collect()) == [("A", 1, 2, None), ("A", 2, 1, None), ("A", 3, 0, "no_progress")]
    assert sorted(r.url[-1] for r in out.discovered.collect()) == ["1", "2", "3"]
    assert sorted((r.product_name, r.price) for r in out.products.collect()) == [("Bomba 1", "1.290"), ("Bomba 3", "3.290")]
    assert [r.url for r in out.rejected.collect()] == ["https://north.example/product/2"]
    report = out.report.first()
    assert (report.urls_discovered, report.urls_unique, report.products_valid, report.rejected, report.limited) == (3, 3, 2, 1, True)
    assert report.estimated_coverage is None and out.snapshot.where("change = 'created'").count() == 2
    limited = catalog_run.run(listings, details, RULE, "audit", max_products=1)
    assert limited.report.first().estimated_coverage is None and [r.url[-1] for r in limited.discovered.collect()] == ["1"]
    # A last page (page 2 names no other one) ends its listing, and the next one begins.
    ended = listings.where("page < 3").withColumn("next_url", F.when(F.col("page") == 1, F.when(F.col("listing_url") == "A", "https://north.example/a?page=2")))
    whole = catalog_run.run(ended, details, RULE, "audit")
    assert sorted((r.listing_url, r.page, r.products, r.reason) for r in whole.pages.collect()) == [("A", 1, 2, None), ("A", 2, 1, None), ("B", 1, 1, "catalog_end")]
    report = whole.report.first()
    assert (report.urls_discovered, report.urls_unique, report.limited) == (4, 3, False) and abs(report.estimated_coverage - 2 / 3) < 1e-9
    assert catalog_run.run(listings, details, RULE, "discover", max_pages=1).products is None


def test_texts_and_scripts(spark):
    scripts = spark.createDataFrame([("u", 'var a = {"producto": {"sku": "1", "t": "}"}}; b({x}); c({"y":2})')], "url string, body string")
    assert [r.object for r in feeds.script_objects(scripts, '"producto"').collect()] == ['{"producto": {"sku": "1", "t": "}"}}']
    row = feeds.raw_record(spark.createDataFrame([("Filtro VW Gol a US$ 1.290,50 c/u",)], "text string")).first()
    assert (row.price, row.currency, row.brand) == ("1.290,50", "USD", "Volkswagen")
    row = feeds.part_record(spark.createDataFrame([("Nº Pieza: 12-AB Precio: $ 99",)], "text string")).first()
    assert (row.sku, row.price) == ("12-AB", "99")
