"""Updates of a snapshot from pages that were read again."""

import datetime

from pyspark.sql import functions as F

from shelfspark.operators import brands, refresh
from shelfspark.schema import conform

AT = datetime.datetime(2024, 1, 1)
STOCK = "id string, site string, source_url string, product_name string, price string, image_url string, image_urls array<string>, compatible_models array<string>, compatible_brands array<string>, attributes map<string,string>, created_at timestamp, updated_at timestamp, search_text string"


def later():
    return F.lit(datetime.datetime(2024, 2, 1))


def stock(spark):
    rows = [
        ("1", "https://a.example/l", "https://a.example/p/1", "Uno", "10", "https://i.example/logo.png", None, None, ["Ford"], {"k": "v"}),
        ("2", "https://a.example/l", "https://www.A.example/p/2/", "Dos", "20", "https://i.example/2.jpg", [], ["Gol"], None, None),
        ("3", "https://b.example/l", "https://b.example/p/3", "Tres", "30", None, None, None, None, None),
        ("4", "https://a.example/l", "https://a.example/p/4", "Cuatro", None, None, None, None, None, None),
        ("5", "https://a.example/l", None, "Cinco", None, None, None, None, None, None),
    ]
    return conform(spark.createDataFrame([(*r, AT, AT, "old") for r in rows], STOCK))


def reasons(df):
    return {r.id: (r.reason, sorted(r.changed)) for r in df.collect()}


def test_links_are_refreshed_once(spark):
    found = spark.createDataFrame(
        [("https://a.example/p/1", True, "Uno", "11", {"k": "w"}, ["Fiesta"], None), ("https://a.example/p/2", False, "other", "99", None, ["gol", "Fox"], None), ("https://a.example/p/4", False, None, None, None, None, None), ("https://b.example/p/3", True, "Tres", "31", None, None, None)],
        "source_url string, is_detail boolean, product_name string, price string, attributes map<string,string>, compatible_models array<string>, compatible_versions array<string>",
    )
    first = refresh.refresh_links(stock(spark), found, " A.example", later())
    assert reasons(first) == {"1": ("update", ["attributes", "compatible_models", "price"]), "2": ("update", ["compatible_models"]), "3": ("not_asked", []), "4": ("nothing_found", []), "5": ("not_asked", [])}
    rows = {r.id: r for r in first.collect()}
    assert (rows["1"].price, rows["1"].product_name, rows["1"].compatible_models, rows["1"].attributes, rows["1"].updated_at.month, rows["1"].created_at.month) == ("11", "Uno", ["Fiesta"], {"k": "w"}, 2, 1)
    assert (rows["2"].price, rows["2"].compatible_models, rows["2"].source_url) == ("20", ["gol", "Fox"], "https://www.A.example/p/2/")
    assert rows["1"].search_text == "uno fiesta ford w" and (rows["4"].search_text, rows["4"].updated_at) == ("old", AT)
    assert tuple(refresh.counts(first).first()) == (3, 2, 0, 1, 0)
    again = refresh.refresh_links(first.drop("reason", "changed"), found, "a.example", later())
    assert tuple(refresh.counts(again).first()) == (3, 0, 2, 1, 0)
    links = spark.createDataFrame([("1", "fiat", "alias", None), ("3", "kia", "alias", None)], "inventory_id string, brand_id string, confidence string, evidence string")
    assert {(r.inventory_id, r.brand_id) for r in refresh.changed_links(links, first).collect()} == {("1", "ford"), ("2", brands.OTHER), ("3", "kia")}


def test_compatibility_of_rows_that_lack_it(spark):
    found = spark.createDataFrame([("https://a.example/p/1", ["Ka"], None, ["FORD", "Fiat"], None), ("https://b.example/p/3", None, None, ["Fiat"], None)], "source_url string, compatible_models array<string>, compatible_versions array<string>, compatible_brands array<string>, compatible_vehicles array<string>")
    out = refresh.refresh_compatibility(stock(spark), found, later())
    assert reasons(out) == {"1": ("update", ["compatible_brands", "compatible_models"]), "2": ("no_page", []), "3": ("nothing_found", []), "4": ("no_page", []), "5": ("not_asked", [])}
    assert out.where("id = '1'").first().compatible_brands == ["FORD", "Fiat"]
    assert tuple(refresh.counts(refresh.refresh_compatibility(stock(spark), found, later(), "b.example")).first()) == (1, 0, 0, 1, 0)


def test_images_are_filled_in(spark):
    found = spark.createDataFrame([("https://a.example/p/1", "https://i.example/1.jpg", ["https://i.example/1.jpg"]), ("https://a.example/p/2", "https://i.example/2.jpg", None), ("https://a.example/p/2", "https://i.example/2.jpg", None), ("https://a.example/p/4", "https://i.example/brand.jpg", None)], "source_url string, image_url string, image_urls array<string>")
    under = ("https://a.example/", "https://www.A.example/", "https://b.example/")
    dry = refresh.backfill_images(stock(spark), found, under, later())
    assert reasons(dry) == {"1": ("update", ["image_url", "image_urls"]), "2": ("unchanged", []), "3": ("no_page", []), "4": ("nothing_found", []), "5": ("not_asked", [])}
    assert dry.where("id = '1'").first().image_url.endswith("logo.png")
    assert tuple(refresh.backfill_summary(dry, False).first()) == (4, 1, 2, 1, 1, 0, 1)
    done = refresh.backfill_images(stock(spark), found, under, later(), apply=True)
    assert done.where("id = '1'").first().image_urls == ["https://i.example/1.jpg"] and tuple(refresh.backfill_summary(done, True).first())[-2:] == (1, 1)
    again = refresh.backfill_images(done.select(*stock(spark).columns), found, under, later(), apply=True)
    assert tuple(refresh.backfill_summary(again, True).first()) == (4, 0, 2, 1, 0, 0, 1)
    assert refresh.backfill_images(stock(spark), found, under, later(), limit=2).where("reason <> 'not_asked'").count() == 2
