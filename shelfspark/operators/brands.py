"""Vehicle brands of products, from a dictionary of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import clean_text, fold, let, padded, plain, plain_key

OTHER = "otros"
# Ids and labels of brands; other aliases than these two.
BRANDS = (
    ("fiat", "Fiat"), ("toyota", "Toyota"), ("chevrolet", "Chevrolet"), ("ford", "Ford"), ("renault", "Renault"), ("volkswagen", "Volkswagen"), ("peugeot", "Peugeot"), ("citroen", "Citroen"), ("hyundai", "Hyundai"), ("kia", "Kia"),
    ("nissan", "Nissan"), ("chery", "Chery"), ("suzuki", "Suzuki"), ("bmw", "BMW"), ("mercedes-benz", "Mercedes Benz"), ("honda", "Honda"), ("mitsubishi", "Mitsubishi"), ("mazda", "Mazda"), ("isuzu", "Isuzu"), ("jeep", "Jeep"),
    ("dodge", "Dodge"), ("chrysler", "Chrysler"), ("geely", "Geely"), ("byd", "BYD"), ("audi", "Audi"), ("volvo", "Volvo"), ("subaru", "Subaru"), ("daewoo", "Daewoo"), ("daihatsu", "Daihatsu"), ("jac", "JAC"),
    ("gwm", "GWM"), ("foton", "Foton"), ("iveco", "Iveco"), ("scania", "Scania"), ("agrale", "Agrale"), ("man", "MAN"), ("otros", "Otros"),
)
ALIASES = {"fiat": ("fi",), "chevrolet": ("chevy",), "volkswagen": ("vw", "v.w."), "citroen": ("citroën",), "mercedes-benz": ("mercedes", "mb")}


def brand_table(spark: SparkSession) -> DataFrame:
    """(brand_id, label, place)"""
    return spark.createDataFrame([(i, label, n) for n, (i, label) in enumerate(BRANDS)], "brand_id string, label string, place int")


def alias_rows() -> list[tuple[str, str, str, int]]:
    """(brand_id, label, alias, place), each alias once a brand."""
    return [(i, label, a, n) for n, (i, label) in enumerate(BRANDS) for a in dict.fromkeys((label, i, *ALIASES.get(i, ())))]


def alias_table(spark: SparkSession) -> DataFrame:
    """The alias dictionary with each alias's plain key; a few dozen rows."""
    rows = spark.createDataFrame(alias_rows(), "brand_id string, label string, alias string, place int")
    return rows.withColumn("alias_key", plain_key(F.col("alias")))


def _dictionary() -> Column:
    """The aliases as a constant array, their keys padded: finding them is an expression, no join."""
    import unicodedata

    def key(x: str) -> str:
        x = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x).split())

    rows = [(i, label, f" {key(a)} ") for i, label, a, _ in alias_rows() if i != OTHER]
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(k).alias("key")) for i, label, k in rows))


def aliases_in(text: Column) -> Column:
    """(id, label) of the brands that a text names as whole words, by label."""
    found = let(padded(plain_key(text)), lambda key: F.filter(_dictionary(), lambda a: F.contains(key, a["key"])))
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: F.struct(a["label"].alias("label"), a["id"].alias("id")))))


def evidence() -> Column:
    """The texts of a product in which brands are looked for."""
    return F.concat_ws(" ", *(clean_text(F.col(c)) for c in ("product_name", "description", "category", "brand", "source_url")), arrays.list_text(F.col("compatible_brands")), arrays.list_text(F.col("compatible_vehicles")), arrays.map_text(F.col("attributes")))


MATCH = "array<struct<label:string,id:string,confidence:string,evidence:string>>"


def infer() -> Column:
    """Brands of a product by label: the listed ones if there are any, else those its texts name, else the entry for others."""
    listed = F.filter(F.transform("compatible_brands", clean_text), lambda x: x.isNotNull())

    def explicit(value: Column) -> Column:
        known = let(padded(plain_key(value)), lambda key: F.get(F.filter(_dictionary(), lambda a: F.contains(key, a["key"])), F.lit(0)))
        unknown = F.struct(value.alias("label"), F.replace(plain_key(value), F.lit(" "), F.lit("-")).alias("id"), F.lit("explicit").alias("confidence"), value.alias("evidence"))
        return F.when(known.isNotNull(), F.struct(known["label"].alias("label"), known["id"].alias("id"), F.lit("alias").alias("confidence"), value.alias("evidence"))).otherwise(unknown)

    first = lambda given, x: F.get(F.filter(given, lambda y: y["id"] == x["id"]), F.lit(0))
    once = let(F.transform(listed, explicit), lambda given: F.array_distinct(F.transform(given, lambda x: first(given, x))))
    named = F.transform(aliases_in(evidence()), lambda x: F.struct(x["label"].alias("label"), x["id"].alias("id"), F.lit("alias").alias("confidence"), F.lit(None).cast("string").alias("evidence")))
    other = F.array(F.struct(F.lit("Otros").alias("label"), F.lit(OTHER).alias("id"), F.lit("fallback").alias("confidence"), F.lit(None).cast("string").alias("evidence")))
    by_text = let(named, lambda found: F.when(F.size(found) > 0, found).otherwise(other))
    return F.when(F.size(listed) > 0, F.array_sort(once)).otherwise(by_text).cast(MATCH)


def brand_links(products: DataFrame, id_column: str = "id") -> DataFrame:
    """(inventory_id, brand_id, confidence, evidence), the rows of the link table."""
    return products.select(F.col(id_column).alias("inventory_id"), F.explode(infer()).alias("b")).select("inventory_id", F.col("b.id").alias("brand_id"), F.col("b.confidence").alias("confidence"), F.col("b.evidence").alias("evidence")).dropDuplicates(["inventory_id", "brand_id"])


def replace_links(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """The link table after all links of the products of ``fresh`` were replaced."""
    return links.join(fresh.select("inventory_id").distinct(), "inventory_id", "left_anti").unionByName(fresh)


def missing_links(inventory: DataFrame, links: DataFrame) -> DataFrame:
    """Links for the products that have none."""
    bare = inventory.join(links.select(F.col("inventory_id").alias("id")), "id", "left_anti")
    return brand_links(bare)


def filter_id(value: str | None) -> str | None:
    """The id that a filter's text means: by id, label or alias, else its slug; None for nothing. Runs on the driver."""
    import unicodedata

    def key(x: str) -> str:
        x = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x).split())

    wanted = key(value or "")
    known = next((i for i, label, a, _ in alias_rows() if wanted in (i, key(label), key(a))), None)
    return known or wanted.replace(" ", "-") or None


def prefer_listing_brand(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds the brand of the listing on which a product was found (``listings``: listing_url, listing_brand)."""
    joined = products.join(listings, "listing_url", "left")
    merged = F.concat(F.coalesce("compatible_brands", F.array().cast("array<string>")), F.array_compact(F.array("listing_brand")))
    return joined.withColumn("compatible_brands", arrays.merge_brands(merged)).drop("listing_brand")


def lexicon_matches(text: Column, names: list[str], extra: dict[str, str] | None = None) -> Column:
    """The names that a text has anywhere, inside of words too, in the lexicon's order; ``extra`` are patterns that add a name."""
    listed = F.array(*(F.struct(F.lit(x).alias("name"), F.lit(plain(x)).alias("key")) for x in names))
    found = lambda t: F.transform(F.filter(listed, lambda x: F.contains(t, x["key"])), lambda x: x["name"])
    more = lambda t: F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(x)) for x, p in (extra or {}).items()))) if extra else F.array().cast("array<string>")
    return let(fold(text), lambda t: F.array_union(found(t), more(t)))


def references(text: Column, code: str = "[A-Z0-9][A-Z0-9./-]{4,}", longest: int = 240) -> Column:
    """Codes of a reference text joined by slashes; a text without codes as it is; null if it is long."""
    codes = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"({code})"), F.lit(1)))
    return let(clean_text(text), lambda t: F.when(F.length(t) <= longest, F.when(F.size(codes(t)) > 0, F.array_join(codes(t), " / ")).otherwise(t)))
