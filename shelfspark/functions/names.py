"""Names of products among the texts of a page: cleaned, judged, scored, and the best one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, fold, let

# Marks of a shop in names, texts that are no names, words that tell a product, and what each is worth.
TAILS = ("(?i)\\s*-\\s*YOKOMITSU\\s*$", "(?i)\\s*[\\u2013-]\\s*yokomitsuparts\\.com\\.uy\\s*$", "['\\u2019](?=(?:19|20)[0-9]{2}\\s*-\\s*(?:$|[^0-9]))")
NO_NAME = "(?i)^(?:inicio|home|catalogo|categor[ií]as?|productos?|ver\\s+detalle|ver\\s+producto|detalle|comprar|consultar|stock|precio|marca|modelo|procedencia|oem|tags?)$"
NO_TEXT = "(?i)function\\s*\\(|\\$\\.ajax|recaptcha|grecaptcha|cookie|login|password|navbar|footer"
CAPITALS, ALL_CAPITALS = "[A-ZÁÉÍÓÚÑ0-9]", "^[A-ZÁÉÍÓÚÑ0-9\\s/'.-]+$"
YEAR = "\\b(?:19|20)[0-9]{2}(?:\\s*[-/]\\s*(?:[0-9]{2,4})?)?"
TRAITS = "(?i)\\b(?:derecho|izquierdo|delantero|trasero|hatchback|sedan|c/|s/|c\\s*/|s\\s*/|con|sin|rejilla|rotula|agj|agujero|agujeros|manual|electrico|eléctrico)\\b"
MODELS = "(?i)\\b(?:rio|soluto|accent|corolla|sentra|corsa|hilux|sail|onix|hb20|tucson|sportage|cerato|picanto)\\b"
LABELS = "(?i)^(?:marca|modelo|procedencia|oem|c[oó]d\\.?\\s*yokomitsu)\\b"
SHORTEST, LONGEST = 4, 180
FIRST, EQUAL, BEGINS, HOLDS, WORD, MOST_WORDS, WITH_YEAR, WITH_TRAIT, WITH_MODEL, IN_CAPITALS, LABEL = 100, 30, 140, 90, 8, 12, 55, 45, 35, 10, -200


def likely_name(text: Column) -> Column:
    """Whether a text can be a product's name."""
    return F.coalesce(~text.rlike(NO_NAME) & ~text.rlike(NO_TEXT) & F.length(text).between(SHORTEST, LONGEST) & text.rlike(CAPITALS), F.lit(False))


def clean_name(text: Column) -> Column:
    """A name without the shop's marks; null if it can be none."""
    bare = clean_text(text)
    for tail in TAILS:
        bare = F.regexp_replace(bare, tail, "")
    return let(clean_text(bare), lambda name: F.when(likely_name(name), name))


def name_from_url(url: Column, marker: str = "producto-detalle", after: int = 3) -> Column:
    """The name that an address spells: the part so many places behind ``marker``, else the last one, in capitals; dashes between numbers stay."""
    path = F.regexp_extract(url, "(?i)^(?:https?://[^/?#]+)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")

    def chosen(found: Column) -> Column:
        at = F.array_position(F.transform(found, lambda x: F.lower(x)), marker)
        return F.when(at > 0, F.get(found, (at - 1 + after).cast("int"))).otherwise(F.get(found, F.size(found) - 1))

    def spelled(slug: Column) -> Column:
        words = F.regexp_replace(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), "([0-9])-(?=[0-9]|$)", "$1\u0001")
        return F.when(~slug.rlike("^[0-9]+$"), clean_name(F.upper(F.replace(F.regexp_replace(words, "[-_]+", " "), F.lit("\u0001"), F.lit("-")))))

    return let(let(parts, chosen), spelled)


def name_score(candidate: Column, base: Column, place: Column) -> Column:
    """What speaks for a candidate; ``base`` is the page's plain title, ``place`` the candidate's place from 0."""
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    some = base != ""
    longer = some & (F.length(fold(candidate)) > F.length(base))
    held = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)

    def points(text: Column) -> Column:
        extra = F.when(some, F.size(F.filter(words(text), lambda w: ~F.array_contains(F.split(base, " "), w)))).otherwise(F.size(F.split(text, " ")))
        return (
            F.greatest(F.lit(0), FIRST - place) + held(some & (text == base), EQUAL) + held(longer & text.startswith(base), BEGINS) + held(longer & F.contains(text, base), HOLDS) + F.least(extra, F.lit(MOST_WORDS)) * WORD
            + held(candidate.rlike(YEAR), WITH_YEAR) + held(candidate.rlike(TRAITS), WITH_TRAIT) + held(candidate.rlike(MODELS), WITH_MODEL) + held(candidate.rlike(ALL_CAPITALS), IN_CAPITALS) + held(candidate.rlike(LABELS), LABEL)
        )

    return let(fold(candidate), points)


def best_name(texts: Column, title: Column) -> Column:
    """Of a page's texts the one that is most likely the product's name: the highest score, of equal ones the first; null if there is none."""
    names = F.array_distinct(F.filter(F.transform(texts, clean_name), lambda x: x.isNotNull()))

    def chosen(found: Column) -> Column:
        base = fold(F.coalesce(clean_text(title), F.get(found, F.lit(0))))
        ranked = F.transform(found, lambda x, i: F.struct(name_score(x, base, i).alias("score"), (-i).alias("place"), x.alias("name")))
        return F.array_max(ranked)["name"]

    return let(names, chosen)
