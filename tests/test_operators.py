"""Golden cases of functions and operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import arrays, price, text, urls
from shelfspark.operators import audit, brands, crawl, dedupe, inventory, jobs, quality
from shelfspark.operators.rules import RuleBook, SiteRule
from shelfspark.schema import ORDER, conform
from shelfspark.sources import feeds, html, tables
from shelfspark.streaming import progress, state_log

RULE = SiteRule("north-parts", ("www.north.example",), product_patterns=("/product/",), category_patterns=("/category/",), exclude_patterns=("/blog/",))
RULES = RuleBook((RULE, SiteRule("south", ("south.example", "tienda.south.example"), label="South")))


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def records(spark, rows):
    schema = {"product_name": "string", "price": "string", "brand": "string", "sku": "string", "description": "string", "availability": "string", "stock": "string", "source_url": "string", "image_url": "string", "compatible_brands": "array<string>", "quality_warnings": "array<string>"}
    data = [tuple(r.get(c) for c in schema) + (i,) for i, r in enumerate(rows)]
    return conform(spark.createDataFrame(data, ", ".join(f"{k} {v}" for k, v in schema.items()) + f", {ORDER} bigint"))


@pytest.mark.parametrize("given,want", [("122", 122), ("1.290", 1290), ("2.427,92", 2427.92), ("1,465.01", 1465.01), ("2606,00", 2606), ("2716.00", 2716), ("2,291", 2291), ("$U 341.319", 341319), ("", None), ("a consultar", None), ("US$ 12,5 c/u", 12.5)])
def test_parse_price(spark, given, want):
    assert one(spark, price.parse_price(F.col("p")), p=given) == want


@pytest.mark.parametrize("given,parsed,key", [("1234.567", 1234.56, 1234567), ("$ 1.290,50", 1290.5, 129050), ("1.2345", 1234, 12345), ("1.290,50", 1290.5, 1290.5)])
def test_the_two_price_parsers_differ(spark, given, parsed, key):
    df = spark.range(1).select(F.lit(given).alias("p")).select(price.parse_price(F.col("p")).alias("a"), price.price_sort_key(F.col("p")).cast("double").alias("b")).first()
    assert (df.a, df.b) == (parsed, key)


@pytest.mark.parametrize("given,want", [("US$ 10", "USD"), ("USD 5", "USD"), ("$U 10", "UYU"), ("$ 10", "UYU"), ("10", None)])
def test_currency(spark, given, want):
    assert one(spark, price.infer_currency(F.lit(None).cast("string"), F.col("p")), p=given) == want


@pytest.mark.parametrize("given,want", [("HTTPS://www.Example.com/product/filtro/?utm=1#top", "https://example.com/product/filtro?utm=1"), ("ftp://a/b", None), ("not a url", None), ("http://a.example:80/x//", "http://a.example/x"), ("https://a.example", "https://a.example")])
def test_canonical_url(spark, given, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=given) == want


@pytest.mark.parametrize("given,want", [("https://Fixture.test/product/a?utm_source=x&color=rojo#d", "https://fixture.test/product/a?color=rojo"), ("https://a.test/P?color=rojo&gclid=1", "https://a.test/P?color=rojo"), ("https://a.test/P?fbclid=1&mc_x=2", "https://a.test/P")])
def test_catalog_url(spark, given, want):
    assert one(spark, urls.catalog_url(F.col("u")), u=given) == want


def test_url_helpers(spark):
    assert one(spark, urls.site_key(F.col("u")), u="https://www.a.example/Útiles y más/page-3/") == "a.example_utiles-y-mas"
    assert one(spark, urls.resolve_url(F.col("b"), F.col("l")), b="https://a.example/x/y", l="../z?q=1") == "https://a.example/z?q=1"
    assert one(spark, urls.resolve_url(F.col("b"), F.col("l")), b="https://a.example/x", l="mailto:a@b") is None
    assert one(spark, urls.widest_source(F.col("s")), s="a.jpg 100w, b.jpg 300w, c.jpg 200w") == "b.jpg"
    assert one(spark, urls.page_urls(F.col("u"), F.lit(3)), u="https://a.example/l") == ["https://a.example/l", "https://a.example/l?page=2", "https://a.example/l?page=3"]


def test_texts(spark):
    assert one(spark, text.clean_text(F.col("t")), t=" a  \n b﻿ ") == "a b"
    assert one(spark, text.clean_text(F.col("t")), t="   ") is None
    assert one(spark, text.fold(F.col("t")), t="  Óptica   Ã³ptica ÑANDÚ") == "optica optica nandu"
    assert one(spark, text.search_text(F.col("t")), t="CORREDERA tteess 1122 é") == "coredera tes 1122"
    assert text.search_tokens(" Réd  aa 11 x CORREDERA") == ["r d", "11", "coredera"]
    assert one(spark, text.labelled_value(F.col("t"), "OEM", ["OEM", "Procedencia"]), t="OEM: 12-A Procedencia: BR") == "12-A"
    assert one(spark, text.first_number(F.col("t"), "([\\d.]+) resultados"), t="1.234 resultados") == 1234
    assert one(spark, text.redact(F.col("t")), t='x?token=abc&y=1 {"password":"p","u":"v"}') == 'x?token=[REDACTED]&y=1 {"password":"[REDACTED]","u":"v"}'
    assert one(spark, text.strip_tags(F.col("t")), t="<p>a &amp; <b>b</b></p>") == "a & b"
    assert one(spark, text.brand_from_text(F.col("t")), t="BOSCH - filtro | x") == "BOSCH"


def test_array_merges(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, arrays.merge_brands(a("Ford", "Citroen", "Volkswagen", "CITROEN"))) == ["Ford", "CITROEN", "Volkswagen"]
    assert one(spark, arrays.merge_brands(a("Otros", "Chevrolet"))) == ["Chevrolet"]
    assert one(spark, arrays.merge_brands(a("Otros"))) == ["Otros"]
    assert one(spark, arrays.merge_texts(a(" ", ""))) is None
    assert one(spark, arrays.union_warnings(a("a", "b"), a("b", "c"))) == ["a", "b", "c"]
    assert one(spark, arrays.split_compatibility(F.lit("Gol 1.6; x;Fiat Uno, Fiat Uno|Palio"))) == ["Gol 1.6", "Fiat Uno", "Palio"]
    assert one(spark, arrays.patch_json(F.lit('{"a":"1","b":"2"}'), "a string, b string", {"a": F.lit("9"), "b": None})) == '{"a":"9"}'


@pytest.mark.parametrize("given,want", [("Producto AGOTADO, no comprar", "out_of_stock"), ("Añadir al carrito", "in_stock"), ("no disponible", "out_of_stock"), ("nada", "unknown")])
def test_availability(spark, given, want):
    assert one(spark, quality.availability(F.col("t")), t=given) == want


def test_warnings_and_gate(spark):
    url = "https://north.example/product/filtro-1"
    rows = [
        {"product_name": "Filtro de aire", "price": "0,00", "source_url": url, "availability": "in_stock"},
        {"product_name": "Filtro de aire", "price": "10", "source_url": url, "availability": "out_of_stock"},
        {"product_name": "Ver más", "price": "10", "source_url": url, "availability": "in_stock"},
        {"product_name": "Motor", "price": "10", "source_url": "https://other.example/product/1"},
        {"product_name": "Motor", "price": "10", "source_url": "https://north.example/cartera/1"},
        {"product_name": "Motor", "price": "10", "source_url": "https://north.example/x/y", "stock": "3", "description": "d" * 1300},
        {},
    ]
    df = records(spark, rows)
    got = [r.quality_warnings for r in quality.annotate(df, RULE).orderBy(ORDER).collect()]
    assert got == [["invalid_price", "not_sellable"], ["not_sellable"], ["invalid_name"], ["external_url", "not_sellable"], ["external_url", "not_sellable"], ["invalid_product_url", "noisy_description"], ["missing_name", "missing_price", "missing_url", "non_automotive", "not_sellable"]]
    assert [r[ORDER] for r in quality.gate(df, RULE).orderBy(ORDER).collect()] == [0, 1]
    strict = SiteRule("n", ("north.example",), product_patterns=("/product/",), keep_out_of_stock=False)
    assert [r[ORDER] for r in quality.gate(df, strict).collect()] == [0]


def test_warning_counts(spark):
    df = records(spark, [{"quality_warnings": ["missing_price", "not_sellable"]}, {"quality_warnings": ["not_sellable"]}, {}])
    assert {r.warning: r.n for r in quality.warning_counts(df).collect()} == {"missing_price": 1, "not_sellable": 2}


def test_blocked_addresses(spark):
    for url, want in (("https://wa.me/1", True), ("https://a.example/carter/1", True), ("https://a.example/p/1", False), ("nothing", True), ("https://a.example/?dispatch=product_features.add_product&x=1", True)):
        assert one(spark, quality.blocked(F.col("u")), u=url) is want
    assert one(spark, quality.allowed(F.col("u"), F.lit("https://www.a.example/")), u="https://a.example/p") is True


def test_merge_products(spark):
    u = "https://a.example/p/1"
    rows = [{"source_url": u, "compatible_brands": ["Ford", "Citroen"], "description": "d", "price": "1", "quality_warnings": ["a"]}, {"product_name": "solo", "compatible_brands": [" x "]}, {"source_url": u.upper(), "compatible_brands": ["Volkswagen", "CITROEN", "Otros"], "price": "2", "quality_warnings": ["b", "a"]}, {}]
    got = dedupe.merge_products(records(spark, rows)).orderBy(ORDER).collect()
    assert [(r[ORDER], r.price, r.description) for r in got] == [(0, "2", "d"), (1, None, None)]
    assert got[0].compatible_brands == ["Ford", "CITROEN", "Volkswagen"] and got[0].quality_warnings == ["a", "b"] and got[1].compatible_brands == [" x "]


def test_merge_products_against_a_fold(spark):
    import random

    rng = random.Random(3)
    rows = [{"source_url": f"https://a.example/{rng.randrange(6)}", "price": rng.choice([None, "1", "2", "3"]), "brand": rng.choice([None, "x", "y"]), "compatible_brands": rng.choice([None, [], ["Ford"], ["FORD", "Fiat"], ["otros"], ["Kia", "kia"]])} for _ in range(60)]
    want = {}
    for r in rows:
        now = want.get(r["source_url"])
        if now is None:
            want[r["source_url"]] = dict(r)
            continue
        merged = {}
        for v in [*(now["compatible_brands"] or []), *(r["compatible_brands"] or [])]:
            merged[v.lower()] = v
        if len(merged) > 1:
            merged.pop("otros", None)
        now |= {k: r[k] if r[k] is not None else now[k] for k in ("price", "brand")} | {"compatible_brands": list(merged.values()) or None}
    got = {r.source_url: (r.price, r.brand, r.compatible_brands) for r in dedupe.merge_products(records(spark, rows)).collect()}
    assert got == {k: (v["price"], v["brand"], v["compatible_brands"]) for k, v in want.items()}


def test_catalog_normalisation(spark):
    rows = [{"source_url": "https://a.example/p?utm_source=1", "product_name": "A"}, {"source_url": "https://a.example/p", "product_name": "B"}, {"sku": "S1"}, {"sku": "s1", "product_name": "C"}, {}]
    out, again = dedupe.normalize_catalog(records(spark, rows), "UYU")
    got = [(r.source_url, r.sku, r.product_name, r.currency) for r in out.orderBy(ORDER).collect()]
    assert got == [("https://a.example/p", None, "B", "UYU"), (None, "s1", "C", "UYU"), (None, None, None, "UYU")]
    assert sorted((r.reason, r.duplicate_of) for r in again.collect()) == [("canonical_url", "https://a.example/p?utm_source=1"), ("sku", None)]
    assert {r.reason for r in dedupe.validate(records(spark, rows), records(spark, rows[:1])).collect()} == {"quality_gate"}


def test_two_keys(spark):
    rows = spark.createDataFrame([("s", "u1", "A", 0), ("s", "u2", "a ", 1), ("s", "u3", None, 2), ("s", None, "A", 3), ("s", None, None, 4)], f"site string, url string, sku string, {ORDER} bigint")
    assert [r._entity for r in dedupe.resolve_two_keys(rows, "site", "url", "sku").orderBy(ORDER).collect()] == ["u1", "u1", "u3", "u1", None]


def test_two_keys_of_one_large_site_need_no_python_group(spark):
    """Against the loop in order of arrival; no site is gathered in Python."""
    import random

    rng, filed, data, want = random.Random(5), {}, [], []
    for i in range(600):
        site, url, sku = rng.choice(["big", "big", "s", None]), rng.choice([None, "", "u1", "u2", f"v{i}"]), rng.choice([None, "", " ", "A", "a ", "B", f"C{i // 7}"])
        code = (sku or "").strip().lower()
        key = (filed.get((site, code)) if code else None) or url
        if code and key:
            filed[site, code] = key
        data.append((site, url, sku, i))
        want.append((i, key))
    rows = spark.createDataFrame(data, f"site string, url string, sku string, {ORDER} bigint").repartition(5)
    got = dedupe.resolve_two_keys(rows, "site", "url", "sku")
    assert got.columns == [*rows.columns, "_entity"]
    assert sorted((r[ORDER], r._entity) for r in got.collect()) == want
    assert "Pandas" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("product,want", [({"product_name": "BOMBA ACEITE CITROEN-PEUGEOT 1.6"}, ["citroen", "peugeot"]), ({"product_name": "ALFOMBRA UNIVERSAL NEGRA"}, ["otros"]), ({"product_name": "SOPORTE POWERFLOW UNIVERSAL"}, ["otros"]), ({"compatible_brands": ["AEOLUS", "Ford Camion"]}, ["aeolus", "ford"]), ({"product_name": "Faro V.W. Gol"}, ["volkswagen"]), ({"product_name": "x", "compatible_brands": ["Otros"]}, ["otros"])])
def test_brand_inference(spark, product, want):
    assert [b.id for b in records(spark, [product]).select(brands.infer().alias("b")).first().b] == want


def test_brand_ids_and_links(spark):
    assert [brands.filter_id(x) for x in ("VW", "V.W.", "Mercedes", "MB", "FI", "CASE IH Tractor", " ", None)] == ["volkswagen", "volkswagen", "mercedes-benz", "mercedes-benz", "fiat", "case-ih-tractor", None, None]
    df = records(spark, [{"product_name": "Fiat Uno"}, {"product_name": "x"}]).withColumn("id", F.col(ORDER))
    links = brands.brand_links(df)
    assert sorted((r.inventory_id, r.brand_id, r.confidence) for r in links.collect()) == [(0, "fiat", "alias"), (1, "otros", "fallback")]
    fresh = links.where("inventory_id = 1").withColumn("brand_id", F.lit("kia"))
    assert sorted(r.brand_id for r in brands.replace_links(links, fresh).collect()) == ["fiat", "kia"]
    assert [r.inventory_id for r in brands.missing_links(df, links.where("inventory_id = 0")).collect()] == [1]
    assert brands.alias_table(spark).where("alias_key = 'v w'").count() == 1 and brands.brand_table(spark).count() == len(brands.BRANDS)


def empty_inventory(spark):
    return conform(spark.createDataFrame([], "id string, site string, created_at timestamp, updated_at timestamp, last_seen_at timestamp, search_text string"))


def test_upsert_then_search(spark):
    day = lambda d: F.lit(datetime.datetime(2024, 1, d))
    first = records(spark, [{"product_name": "Filtro", "source_url": "https://www.a.example/p/"}, {"product_name": "Filtro de aceite", "source_url": "https://a.example/p"}])
    one_ = inventory.upsert(empty_inventory(spark), first, "https://a.example", day(1))
    assert inventory.upsert_counts(one_).first().asDict() == {"created": 1, "updated": 0, "total": 1}
    kept = one_.drop("change")
    two = inventory.upsert(kept, records(spark, [{"product_name": "Filtro", "sku": "ZX-9", "source_url": "https://a.example/p"}]), "https://www.A.example/list", day(2))
    assert inventory.upsert_counts(two).first().updated == 1
    row = inventory.apply_filters(two, inventory.Filters(search="zx 9", site="a.example")).first()
    assert row.created_at.day == 1 and row.updated_at.day == 2 and row.id == one_.first().id
    assert inventory.apply_filters(two, inventory.Filters(search="aceite")).count() == 0


def test_filters(spark):
    assert inventory.clamp(500, 15) == (200, 15) and inventory.clamp(None, -3) == (200, 0) and inventory.clamp(float("nan"), 2.9) == (200, 2) and inventory.clamp(0, None) == (1, 0)
    assert RULES.hosts_for("North Parts") == ["north.example"] and RULES.hosts_for("https://www.north.example/x") == ["north.example"] and RULES.hosts_for("?") == [] and RULES.hosts_for("new.example") == ["new.example"]
    rows = spark.createDataFrame([("1", "https://www.north.example/l", " ", "disponible", "x", 1), ("2", "http://south.example", "5", "In Stock", "y", 2), ("3", "http://south.example", None, None, "y", 3)], "id string, site string, price string, availability string, search_text string, updated_at int")
    ids = lambda **f: [r.id for r in inventory.apply_filters(rows, inventory.Filters(**f), None, RULES).orderBy("id").collect()]
    assert ids(site="north-parts") == ["1"] and ids(site="??") == [] and ids(price_state="without-price") == ["1", "3"] and ids(price_state="bogus") == ["1", "2", "3"]
    assert ids(availability="available") == ["2"] and ids(availability="unknown") == ["3"]
    links = spark.createDataFrame([("2", "fiat")], "inventory_id string, brand_id string")
    assert [r.id for r in inventory.apply_filters(rows, inventory.Filters(vehicle_brand="FI"), links).collect()] == ["2"]
    page, total, more = inventory.page_with_total(rows, inventory.Filters(price_order="asc"), 2, 0)
    assert [r.id for r in page.collect()] == ["2", "3"] and total == 3 and more
    stats = {(r.host, r.label, r.n) for r in inventory.site_stats(rows, RULES.table(spark)).collect()}
    assert stats == {("south.example", "South", 2), ("north.example", "North Parts", 1)}


def test_overlay_and_backfills(spark):
    listing = records(spark, [{"source_url": "u1", "price": "1", "compatible_brands": ["Fiat"]}, {"source_url": "u2", "price": "2"}])
    detail = records(spark, [{"source_url": "u1", "description": "d", "compatible_brands": ["Kia"]}]).select("source_url", "price", "description", "compatible_brands")
    got = {r.source_url: r for r in inventory.overlay(listing, detail, "source_url").collect()}
    assert got["u1"].price == "1" and got["u1"].description == "d" and got["u1"].compatible_brands == ["Fiat", "Kia"] and got["u2"].compatible_brands is None
    found = spark.createDataFrame([("u1", "https://i.example/a.jpg"), ("u2", "https://i.example/logo.png")], "source_url string, new_image string")
    reasons = {r.source_url: r.reason for r in inventory.backfill_images(listing, found, ("u",), quality.valid_image(F.col("new_image"))).collect()}
    assert reasons == {"u1": "update", "u2": "invalid_image"}
    assert inventory.needs_compatibility(listing.withColumn("site", F.lit("S"))).count() == 2
    assert {r["name"]: r["n"] for r in inventory.reset_counts({"a": listing, "b": detail}).collect()} == {"a": 2, "b": 1}


def test_audit(spark):
    web = spark.createDataFrame([(f"https://www.a.example/p/{i}/",) for i in (1, 2, 3)], "source_url string")
    base = spark.createDataFrame([("https://a.example/p/1",), ("https://a.example/p/2",), ("https://a.example/p/old",)], "source_url string")
    compared = audit.compare(web, base)
    row = audit.coverage(compared).first()
    assert (row.coverage_percent, row.missing, row.stale) == (66.67, 1, 1)
    assert audit.coverage(audit.compare(web.limit(0), base.limit(0))).first().coverage_percent == 100 and audit.coverage(audit.compare(web.limit(0), base)).first().coverage_percent == 0
    for percent, price_, want in ((69.99, 0, "CRITICAL"), (90.0, 0, "REVIEW"), (99.0, 0, "OK"), (99.0, 1, "REVIEW")):
        zero = F.lit(0)
        assert one(spark, audit.status(F.lit(percent), zero, zero, zero, F.lit(price_), zero, zero)) == want
    pages = spark.createDataFrame([("A", "a1", 1, 10, 10), ("A", "a2", 2, 10, 0), ("B", "b1", 1, 5, 5), (None, "c", None, 1, 1)], "listing_url string, url string, page int, product_count int, new_in_listing int")
    got = {r.listing: (r.last_page, r.visited_last_page, r.repeated_pairs) for r in audit.pagination(pages).collect()}
    assert got == {"A": (2, True, 1), "B": (1, True, 0), "c": (1, False, 0)}
    counts = audit.pipeline_counts(spark.createDataFrame([("u",), ("u",), ("v",)], "url string"), web, records(spark, [{"price": "1"}]), False).first()
    assert (counts.urls_unique, counts.duplicates, counts.estimated_coverage) == (2, 1, 0.5)
    assert audit.pipeline_counts(spark.createDataFrame([], "url string"), web, records(spark, [{}]), True).first().estimated_coverage is None
    audits = spark.createDataFrame([("a", "OK", 99.0, 0), ("b", "CRITICAL", 50.0, 1), ("c", "REVIEW", 90.0, 0)], "site string, status string, coverage_percent double, errors int")
    assert [r.site for r in audit.by_severity(audits).collect()] == ["b", "c", "a"]


def test_crawl(spark):
    pages = spark.createDataFrame([("https://www.north.example/l", '<a href="/product/1">x</a><A class="c" HREF=\'/category/2?utm_source=a\'>y</A><a href="/blog/product/3">z</a><a href="javascript:0">w</a>')], "url string, html string")
    got = [(r.target, r.kind) for r in crawl.links(pages).withColumn("kind", crawl.classify(F.col("target"), RULE)).orderBy("position").collect()]
    assert got == [("https://www.north.example/product/1", "product"), ("https://www.north.example/category/2", "category"), ("https://www.north.example/blog/product/3", "none"), (None, "none")]
    assert one(spark, crawl.same_host(F.col("u"), "north.example"), u="https://api.north.example/x") is True
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    assert {(r.node, r.depth) for r in crawl.reachable(spark.createDataFrame([("a",)], "node string"), edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert RULES.without_sites(pages, "url", "North-Parts, x").count() == 0 and pages.where(RULES.admitted(F.col("url"))).count() == 1
    assert [r.url for r in crawl.prioritize(spark.createDataFrame([("https://a/x", 0), ("https://a/product/1", 1)], "url string, o int"), "url", "o", RULE).collect()] == ["https://a/product/1", "https://a/x"]
    assert one(spark, crawl.link_score(F.col("u"), F.lit("Ver"), RULE), u="https://a.example/product/1") == 128


def test_jobs(spark):
    events = spark.createDataFrame([("j", "s1", "processing", 1, 1), ("j", "s1", "success", 5, 2), ("j", "s2", "processing", 2, 1)], "job string, site string, status string, quantity int, ts int")
    last = jobs.latest(events, ["job", "site"], ["ts"])
    assert jobs.roll_up(last, "job").first().asDict() == {"job": "j", "total_sites": 2, "completed_sites": 1, "active_sites": 1, "total_products": 7}
    assert jobs.last_site_with(last.withColumn("product", F.when(F.col("site") == "s1", "p")), "job", "site", "product").first().current_site == "s1"
    queue = spark.createDataFrame([("b", "queued", 2), ("a", "queued", 1), ("c", "done", 0)], "id string, status string, created_at int")
    assert jobs.next_job(queue).first().id == "a"
    runs = spark.createDataFrame([(str(i), i) for i in range(30)], "id string, requested_at int")
    assert jobs.runs_page(runs).count() == 20 and jobs.runs_page(runs, 500).count() == 30
    states = spark.createDataFrame([("j", "queued", 1, 1), ("j", "processing", 2, 2), ("j", "queued", 3, 3)], "job_id string, status string, ts int, seq int")
    assert [r.valid for r in jobs.transitions(states).orderBy("ts").collect()] == [True, True, False]
    stored = spark.createDataFrame([("r", "a", 1), ("r", "b", 1)], "run_id string, site string, v int")
    assert sorted((r.site, r.v) for r in jobs.merge_run_sites(stored, stored.where("site = 'a'").withColumn("v", F.lit(2))).collect()) == [("a", 2), ("b", 1)]


def test_shop_feed(spark):
    body = '{"products":[{"title":"Filtro","handle":"filtro-x","vendor":"V","body_html":"<p>d &amp; e</p>","images":[{"src":"//c.example/i.jpg"}],"variants":[{"price":"700.00","sku":"1","available":false},{"price":"792.00","sku":"204009","available":true}]},{"title":"No price","handle":"n","variants":[]},{"title":"Gone","handle":"g","variants":[{"price":"5","available":false}]}]}'
    got = feeds.shop_products(spark.createDataFrame([("https://s.example/products.json", body), ("https://s.example", "broken")], "base_url string, body string")).orderBy("place").collect()
    assert [(r.source_url, r.price, r.sku, r.availability) for r in got] == [("https://s.example/products/filtro-x", "792.00", "204009", "in_stock"), ("https://s.example/products/g", "5", None, "out_of_stock")]
    assert got[0].description == "d & e" and got[0].image_url == "https://c.example/i.jpg"


def test_tenant_feed(spark):
    item = '{{"codigo":"C{}","descripcion_corta":"Filtro","no_comprable":"{}","stock":"{}","precio":"1.290","moneda":"US$","rubro":"R","subrubro":"S"}}'
    items = ",".join(item.format(i, n, s) for i, (n, s) in enumerate([("S", "5"), (" SI ", "5"), ("1", "5"), ("true", "5"), ("N", "5"), ("N", "0"), ("N", "mucho")]))
    df = spark.createDataFrame([("https://t.example/f", f'{{"cantidad_registros":"7","productos":[{items}]}}'), ("https://t.example/g", f"[{items}]")], "source_url string, body string")
    got = feeds.tenant_products(df, "https://t.example/p?codigo=").orderBy("feed_url", "place").collect()
    assert [r.availability for r in got] == (["out_of_stock"] * 4 + ["in_stock", "out_of_stock", "unknown"]) * 2
    assert got[0].category == "R / S" and got[0].source_url == "https://t.example/p?codigo=C0" and got[0].currency == "USD"


def test_unknown_feeds_and_linked_data(spark):
    body = '{"data":[{"title":"A","price":12,"code":"c1","nested":{"name":"B","salePrice":"1.290","available":false}}]}'
    got = feeds.harvested_products(spark.createDataFrame([("u", body), ("v", "{")], "url string, body string")).orderBy("place").collect()
    assert [(r.product_name, r.price, r.sku, r.availability) for r in got] == [("A", "12", "c1", "in_stock"), ("B", "1.290", None, "out_of_stock")]
    page = '<html><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P","image":["/i.jpg"],"brand":{"name":"Br"},"offers":[{"price":"99,5","priceCurrency":"usd","availability":"https://schema.org/InStock"}]},{"@type":"Thing","name":"no"}]}</script></html>'
    scripts = html.embedded_json(html.elements(spark.createDataFrame([("https://a.example/x", page)], "url string, html string")))
    row = feeds.linked_data_products(scripts).first()
    assert (row.product_name, row.price, row.currency, row.brand, row.availability, row.image_url) == ("P", "99,5", "USD", "Br", "in_stock", "https://a.example/i.jpg")
    assert feeds.alias_record(spark.createDataFrame([("u", '{"nombre":"N","marca":"M"}')], "url string, body string"), {"product_name": ["name", "nombre"], "brand": ["brand", "marca"]}).first().product_name == "N"
    wrapped = feeds.unwrap_envelope(spark.createDataFrame([('{"d":"<p>x</p>","cantArticulos":12}',), ("<p>y</p>",)], "body string")).collect()
    assert [(r.html, r.total) for r in wrapped] == [("<p>x</p>", 12), ("<p>y</p>", None)]


def test_listing_and_detail_pages(spark):
    card = '<div class="product-item"><a href="/p/{0}?utm_source=z"><img src="/i/{0}.jpg"></a><h3>Filtro {0}</h3><span class="price">$U 1.29{0}</span><button>{1}</button></div>'
    page = "<html><body>" + card.format(1, "Agregar al carrito") + card.format(2, "Agotado") + '<div class="product-item"><h3>no link</h3></div></body></html>'
    df = spark.createDataFrame([("https://a.example/list", page), ("https://a.example/none", None), ("https://a.example/bad", "<div><p>x<div")], "url string, html string")
    got = html.listing_products(df, ".product-item").orderBy("card").collect()
    assert [(r.product_name, r.price, r.source_url, r.availability, r.image_url) for r in got] == [("Filtro 1", "1.291", "https://a.example/p/1", "in_stock", "https://a.example/i/1.jpg"), ("Filtro 2", "1.292", "https://a.example/p/2", "out_of_stock", "https://a.example/i/2.jpg")]
    detail = '<html><head><title>t</title><meta property="og:image" content="/o.png"></head><body><h1>Bomba</h1><div class="precio">$ 2.427,92</div><table><tr><th>Marca:</th><td>Kia</td></tr></table><span class="sku">A-1</span></body></html>'
    pages = spark.createDataFrame([("https://a.example/p/1", detail), ("https://a.example/p/2", "<html><h1>404 no</h1></html>")], "url string, html string")
    row = html.detail_products(pages).collect()
    assert [(r.product_name, r.price, r.sku, r.image_url) for r in row] == [("Bomba", "2.427,92", "A-1", "https://a.example/o.png")]
    assert html.label_values(html.elements(pages)).first()["values"] == {"Marca": "Kia"}
    seeds = html.brand_seeds(spark.createDataFrame([("https://a.example/", '<a href="/marca/fiat"></a><a href="/marca/fiat">Fiat</a><select><option value="/marca/kia">Kia</option></select>')], "url string, html string"), "/marca/")
    assert [(r.seed, r.label) for r in seeds.orderBy("place").collect()] == [("https://a.example/marca/fiat", "Fiat"), ("https://a.example/marca/kia", "Kia")]


def test_two_lists_by_address(spark):
    """Orders that are structs, as whole runs write them, and plain ones."""
    rows = lambda *r: records(spark, [dict(x) for x in r])
    base = rows({"source_url": "https://a.example/1", "price": "1", "sku": "S"}, {"source_url": "https://a.example/2", "price": "5"}, {"product_name": "bare"})
    incoming = rows({"source_url": "HTTPS://A.example/1 ", "price": "2"}, {"source_url": "https://a.example/3", "price": "7"})
    for change in (lambda df: df, lambda df: df.withColumn(ORDER, F.struct(F.lit("l").alias("listing"), F.col(ORDER).alias("n")))):
        got = dedupe.merge_by_address(change(base), change(incoming)).orderBy(ORDER).collect()
        assert [(r.price, r.sku) for r in got] == [("2", "S"), ("5", None), ("7", None)]


def test_brand_of_the_listing(spark):
    products = conform(spark.createDataFrame([("l1", ["Otros"]), ("l1", ["Ford"]), ("l2", None), ("none", ["Kia"])], "listing_url string, compatible_brands array<string>"))
    listings = spark.createDataFrame([("l1", "Fiat"), ("l2", "BMW")], "listing_url string, listing_brand string")
    got = sorted((r.listing_url, r.compatible_brands) for r in brands.prefer_listing_brand(products, listings).collect())
    assert got == [("l1", ["Fiat"]), ("l1", ["Ford", "Fiat"]), ("l2", ["BMW"]), ("none", ["Kia"])]


def test_groups_of_possible_duplicates(spark):
    image = "https://i.example/default.jpg"
    df = records(spark, [{"product_name": "A", "image_url": image, "source_url": f"https://a.example/{i % 3}"} for i in range(5)] + [{"product_name": "á", "image_url": image}, {"product_name": "B", "image_url": image}, {"product_name": "A", "brand": "x", "image_url": image}, {"product_name": "A"}])
    groups, members = audit.possible_duplicates(df)
    assert [(r.n, r.n_urls) for r in groups.collect()] == [(6, 3)]
    assert sorted((r.url[-1], r.n) for r in members.collect()) == [("0", 2), ("1", 2), ("2", 1)]


def test_tables(spark, tmp_path):
    df = records(spark, [{"product_name": "A"}]).withColumn("site", F.lit("https://www.a.example/l"))
    tables.archive(df, str(tmp_path / "archive"))
    assert tables.read_products(spark, str(tmp_path / "archive"), "json").first().product_name == "A"
    tables.write_report(spark.createDataFrame([('m"x', "1")], "metric string, value string"), str(tmp_path / "report"))
    assert 'm""x' in next((tmp_path / "report").glob("*.csv")).read_text()
    assert tables.write_snapshot(df, str(tmp_path / "t"), 3).endswith("version=3")


def test_streams_go_on_where_they_ended(spark, tmp_path):
    schema = "job string, site string, n int, ts timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("j", "a", 1, at(0)), ("j", "a", 2, at(1)), ("j", "b", 1, at(1))], schema).write.parquet(src)
    merge = state_log.state_log(state, ["job", "site"], ["ts"])
    progress.drain(progress.read_events(spark, src, schema), str(tmp_path / "c1"), merge, "update")
    spark.createDataFrame([("j", "b", 9, at(5)), ("k", "a", 1, at(2))], schema).write.mode("append").parquet(src)
    progress.drain(progress.read_events(spark, src, schema), str(tmp_path / "c1"), merge, "update")
    assert sorted((r.job, r.site, r.n) for r in state_log.read_log(spark, state, schema, ["job", "site"], ["ts"]).collect()) == [("j", "a", 2), ("j", "b", 9), ("k", "a", 1)]
    late = spark.createDataFrame([("j", "b", 7, at(3))], schema)
    merge(late, 2)
    assert {(r.job, r.site, r.n) for r in state_log.read_log(spark, state, schema, ["job", "site"], ["ts"]).collect()} == {("j", "a", 2), ("j", "b", 9), ("k", "a", 1)}
    query = progress.follow(progress.read_events(spark, src, schema), str(tmp_path / "c4"), merge, 1)
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    out = str(tmp_path / "distinct")
    progress.drain(progress.distinct_events(progress.read_events(spark, src, schema), ["job", "site"], "ts"), str(tmp_path / "c2"), out)
    assert spark.read.parquet(out).count() == 3
    counts = str(tmp_path / "counts")
    progress.drain(progress.windowed_counts(progress.read_events(spark, src, schema), "ts", ["job"], "2 minutes"), str(tmp_path / "c3"), lambda df, i: df.write.mode("append").parquet(counts), "update")
    assert sum(r.n for r in spark.read.parquet(counts).collect()) == 5
