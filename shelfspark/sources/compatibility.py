"""Which vehicles a product fits, from the tables, lists and labels of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import split_compatibility
from ..functions.text import SPACES, clean_text, let, unaccent
from . import html
from .html import attribute, inside, text_of

#: The four lists, in the order in which entries name them.
LISTS = ("compatible_vehicles", "compatible_brands", "compatible_models", "compatible_versions")
VEHICLE, BRAND, MODEL, VERSION = range(4)

# Selectors and labels of each kind of table or list.
ROWS, CELLS = "table tr", "td[data-label]"
TABLES, HEADS, BODY_ROWS, BODY_CELLS = ".table_obs table, table.modal-marcas-modelos", "thead th", "tbody tr", "td"
ITEMS, TITLES, VALUES = ".blkCaracteristicas .it, .lstCaracteristicas .it", ".tit", ".val"
TEXT_ITEMS = ".item-texto"
GROUPS, FEATURES, LABELS, SUBHEADS, CHOICES = ".ty-product-feature-group", ".ty-product-feature", ".ty-product-feature__label", ".ty-subheader", ".ty-product-feature__multiple-item"
SECTIONS, LINES = ".producto__info--modelos", ".producto__info--modelos--linea"
MARKED = (
    "[class*=compat], [id*=compat], [class*=vehicul], [id*=vehicul], [class*=aplicacion], [id*=aplicacion], .modelo, [id*=modelo], [class*=version], [id*=version], .gendataminitit, a.block[href*=showmod], "
    ".blkCaracteristicas .it, .lstCaracteristicas .it, .item-texto"
)
SIGN = "(?i)compat|veh[ií]culo|aplicaci[oó]n|modelo|versi[oó]n|showmod"
VERSION_LABELS = ("motor ano", "motor / ano")
LONGEST_ENTRY = 800
ENTRY = "array<struct<kind:int,value:string>>"


def _label(text: Column) -> Column:
    """A label for comparisons: lower case without accents, one space."""
    return F.trim(F.regexp_replace(unaccent(F.lower(F.coalesce(text, F.lit("")))), SPACES, " "))


def _entry(kind: int, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _entries(kind: int, values: Column) -> Column:
    return F.transform(values, lambda v: _entry(kind, v))


def _known(*entries: Column) -> Column:
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def _within(nodes: Column, box: Column) -> Column:
    return F.filter(nodes, lambda n: inside(n, box) & (n["node"] > box["node"]))


def _first(nodes: Column) -> Column:
    return text_of(F.get(nodes, F.lit(0)))


def _fits(brand: Column, values: Column) -> Column:
    """A brand with its models."""
    pairs = F.transform(values, lambda v: F.array(_entry(MODEL, v), _entry(VEHICLE, F.concat_ws(" - ", brand, v))))
    return F.concat(F.array(_entry(BRAND, brand)), F.flatten(pairs))


def _table_rows() -> Column:
    """Rows whose cells say what they are."""

    def of(row: Column) -> Column:
        cells = F.transform(_within(F.col("_cells"), row), lambda c: F.struct(_label(attribute(c, "data-label")).alias("label"), text_of(c).alias("value")))
        last = lambda found, label: F.get(F.reverse(F.filter(found, lambda c: c["label"] == label)), F.lit(0))["value"]
        named = lambda b, m, v: F.when(F.coalesce(b, m, v).isNotNull(), _known(_entry(BRAND, b), _entry(MODEL, m), _entry(VERSION, v), _entry(VEHICLE, F.concat_ws(" - ", b, m, v))))
        return F.coalesce(let(cells, lambda found: named(last(found, "marca"), last(found, "modelo"), F.coalesce(*(last(found, x) for x in VERSION_LABELS)))), F.array().cast(ENTRY))

    return F.flatten(F.transform("_rows", of))


def _headed_tables() -> Column:
    """Tables with a column of brands and one of models."""

    def of(table: Column) -> Column:
        heads = F.transform(_within(F.col("_heads"), table), lambda h: _label(text_of(h)))
        place = lambda label: F.array_position(heads, label) - 1

        def row(r: Column) -> Column:
            at = lambda label: text_of(F.get(_within(F.col("_body_cells"), r), place(label).cast("int")))
            return let(F.struct(at("marca").alias("b"), at("modelo").alias("m")), lambda x: _known(_entry(BRAND, x["b"]), _entry(MODEL, x["m"]), _entry(VEHICLE, F.when(x["b"].isNotNull() & x["m"].isNotNull(), F.concat_ws(" - ", x["b"], x["m"])))))

        rows = F.flatten(F.transform(_within(F.col("_body_rows"), table), row))
        return F.when((place("marca") >= 0) & (place("modelo") >= 0), rows).otherwise(F.array().cast(ENTRY))

    return F.flatten(F.transform("_tables", of))


def _characteristics() -> Column:
    """Items of which the title says what the value is."""

    def of(item: Column) -> Column:
        title, value = _first(_within(F.col("_titles"), item)), _first(_within(F.col("_values"), item))
        after = lambda text, pattern: split_compatibility(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
        kinds = lambda text: F.concat(*(F.coalesce(_entries(k, after(text, p)), F.array().cast(ENTRY)) for k, p in ((MODEL, "(?i)^modelos?\\s+(.+)$"), (BRAND, "(?i)^compatibilidad\\s+(.+)$"), (VERSION, "(?i)^versiones?\\s+(.+)$"))))
        return let(F.coalesce(F.when(title.isNotNull() & value.isNotNull(), F.concat_ws(" ", title, value)), text_of(item), F.lit("")), kinds)

    return F.flatten(F.transform("_items", of))


def _paragraphs() -> Column:
    """Paragraphs that name a brand, then its models."""

    def of(item: Column) -> Column:
        texts = F.filter(F.transform(_within(F.col("_ps"), item), text_of), lambda t: t.isNotNull())
        pairs = F.transform(texts, lambda t: F.struct(clean_text(F.nullif(F.regexp_extract(t, "(?i)^marca\\s*:\\s*(.+)$", 1), F.lit(""))).alias("brand"), F.nullif(F.regexp_extract(t, "(?i)^modelos?\\s*:\\s*(.+)$", 1), F.lit("")).alias("models")))

        def each(found: Column) -> Column:
            current = lambda i: F.get(F.reverse(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x["brand"].isNotNull())), F.lit(0))["brand"]
            models = lambda x, i: F.flatten(F.transform(split_compatibility(x["models"]), lambda v: _known(_entry(MODEL, v), _entry(VEHICLE, F.when(current(i).isNotNull(), F.concat_ws(" - ", current(i), v))))))
            return F.flatten(F.transform(found, lambda x, i: F.when(x["brand"].isNotNull(), F.array(_entry(BRAND, x["brand"]))).when(x["models"].isNotNull(), models(x, i)).otherwise(F.array().cast(ENTRY))))

        return let(pairs, each)

    return F.flatten(F.transform("_text_items", of))


def _feature_groups() -> Column:
    """Groups of features headed by the word for model, each with a brand and its models."""

    def of(group: Column) -> Column:
        head = _first(_within(F.col("_heads_of_groups"), group))

        def feature(f: Column) -> Column:
            brand = F.regexp_replace(_first(_within(F.col("_labels"), f)), "\\s*:\\s*$", "")
            models = F.filter(F.transform(_within(F.col("_choices"), f), text_of), lambda t: t.isNotNull())
            good = brand.isNotNull() & ~brand.rlike("(?i)^(?:fabricante|marca|modelo)$") & (F.size(models) > 0)
            return F.when(good, _fits(brand, models)).otherwise(F.array().cast(ENTRY))

        return F.when(_label(head) == "modelo", F.flatten(F.transform(_within(F.col("_features"), group), feature))).otherwise(F.array().cast(ENTRY))

    return F.flatten(F.transform("_groups", of))


def _sections() -> Column:
    """Sections of compatible models, a line for each brand."""

    def of(section: Column) -> Column:
        def line(x: Column) -> Column:
            text = F.coalesce(text_of(x), F.lit(""))
            part = lambda n: F.nullif(F.regexp_extract(text, "^([^:]+):\\s*(.+)$", n), F.lit(""))
            brand = F.coalesce(F.regexp_replace(_first(_within(F.col("_h4"), x)), "\\s*:\\s*$", ""), clean_text(part(1)))
            models = split_compatibility(F.coalesce(_first(_within(F.col("_h5"), x)), part(2)))
            return F.when(brand.isNotNull() & (brand != "") & (F.size(models) > 0), _fits(brand, models)).otherwise(F.array().cast(ENTRY))

        headed = F.coalesce(_first(_within(F.col("_h3"), section)), F.lit("")).rlike("(?i)^modelos? compatibles\\s*:")
        return F.when(headed, F.flatten(F.transform(_within(F.col("_lines"), section), line))).otherwise(F.array().cast(ENTRY))

    return F.flatten(F.transform("_sections", of))


def _marked() -> Column:
    """Elements whose class, id or address says what they hold."""

    def of(x: Column) -> Column:
        marker = F.concat_ws(" ", F.array_join(x["classes"], " "), x["id"])
        href = F.coalesce(attribute(x, "href"), F.lit(""))
        parts = _within(F.col("_parts"), x)
        texts = F.filter(F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(x)), text_of), lambda t: t.isNotNull() & (F.length(t) <= LONGEST_ENTRY))
        bare = lambda t: split_compatibility(F.regexp_replace(t, "^[^:]{0,80}:", ""))
        models = marker.rlike("(?i)modelo|showmod") | href.rlike("(?i)modelo|showmod")
        none = F.array().cast(ENTRY)
        each = lambda t: F.concat(
            F.when(marker.rlike("(?i)compat|aplicaci[oó]n"), _entries(VEHICLE, split_compatibility(t))).otherwise(none),
            F.when(models, _entries(MODEL, bare(t))).otherwise(none),
            F.when(href.rlike("(?i)showmod") | marker.rlike("(?i)versi[oó]n"), _entries(VERSION, bare(t))).otherwise(none),
        )
        signed = F.concat_ws(" ", marker, text_of(x), href).rlike(SIGN)
        return F.when(signed, F.flatten(F.transform(texts, each))).otherwise(none)

    return F.flatten(F.transform("_marked", of))


def compatibility(pages: DataFrame) -> DataFrame:
    """``pages`` (html) with the four lists of ``LISTS``, each value once in order of kinds of places, then of the page; null if there is none."""
    parts = {
        "_rows": ROWS, "_cells": CELLS, "_tables": TABLES, "_heads": HEADS, "_body_rows": BODY_ROWS, "_body_cells": BODY_CELLS, "_items": ITEMS, "_titles": TITLES, "_values": VALUES, "_text_items": TEXT_ITEMS, "_ps": "p", "_groups": GROUPS,
        "_features": FEATURES, "_labels": LABELS, "_heads_of_groups": f"{SUBHEADS}, {LABELS}", "_choices": CHOICES, "_sections": SECTIONS, "_lines": LINES, "_h3": "h3", "_h4": "h4", "_h5": "h5", "_marked": MARKED, "_parts": "p, li, td, dd",
    }
    found = html.parse(pages).select("*", *(html.select(s).alias(c) for c, s in parts.items()))
    entries = F.concat(*(F.coalesce(x.cast(ENTRY), F.array().cast(ENTRY)) for x in (_table_rows(), _headed_tables(), _characteristics(), _paragraphs(), _feature_groups(), _sections(), _marked())))
    listed = found.select(*pages.columns, entries.alias("_entries"))
    of = lambda kind: let(F.array_distinct(F.transform(F.filter("_entries", lambda e: e["kind"] == kind), lambda e: e["value"])), lambda v: F.when(F.size(v) > 0, v))
    return listed.select(*pages.columns, *(of(kind).alias(c) for kind, c in enumerate(LISTS)))
