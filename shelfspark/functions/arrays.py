"""Merging of arrays of texts, and small helpers on maps and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, fold, let

OTHER_BRANDS = "otros"


def merge_texts(values: Column, key: Callable[[Column], Column] = fold) -> Column:
    """Texts with equal keys become one: at the first one's place, as the last one is written; blanks go; null if none is left."""
    clean = F.filter(F.transform(values, clean_text), lambda x: x.isNotNull())
    # In order of keys and places, each key's first and last entries stand at the ends of its run.
    pairs = F.array_sort(F.transform(clean, lambda x, i: F.struct(key(x).alias("key"), i.alias("place"), x.alias("text"))))
    ends = lambda found, step: F.filter(found, lambda p, i: ~F.get(found, i + step)["key"].eqNullSafe(p["key"]))
    placed = let(pairs, lambda found: F.array_sort(F.zip_with(ends(found, -1), ends(found, 1), lambda a, b: F.struct(a["place"].alias("place"), b["text"].alias("text")))))
    return let(F.transform(placed, lambda x: x["text"]), lambda m: F.when(F.size(m) > 0, m))


def merge_brands(values: Column) -> Column:
    """``merge_texts`` without the entry for other brands, if there are others."""
    real = lambda m: F.filter(m, lambda x: fold(x) != OTHER_BRANDS)
    return let(merge_texts(values), lambda m: F.when(F.size(m) > 1, real(m)).otherwise(m))


def merge_lower(values: Column) -> Column:
    """``merge_texts`` that tells accents apart."""
    return merge_texts(values, lambda x: F.lower(F.trim(x)))


def union_warnings(before: Column, after: Column) -> Column:
    """Both lists' codes once; one list alone if the other is empty."""
    return F.when(F.coalesce(F.size(before), F.lit(0)) <= 0, after).when(F.coalesce(F.size(after), F.lit(0)) <= 0, before).otherwise(F.array_union(before, after))


# Entries that are a control's or a label's text.
NO_VEHICLE = "(?i)^(?:modelo\\.{0,3}|buscar|todos los modelos|seleccione la marca|ver modelos)$|^(?:compatibilidad|veh[ií]culos?|aplicaci[oó]n|modelos?|versiones?)\\s*:?[\\s-]*$"


def split_compatibility(text: Column) -> Column:
    """Entries of a compatibility cell: cut at line ends, semicolons, commas, bars and bullets, of 2 to 240 characters, without what is no vehicle."""
    parts = F.transform(F.split(text, "[\\n;,|•]+"), clean_text)
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & F.length(x).between(2, 240) & ~x.rlike(NO_VEHICLE)))


def compact_map(values: Column) -> Column:
    """A map without blank values."""
    return F.map_filter(values, lambda _, v: clean_text(v).isNotNull())


def map_text(values: Column) -> Column:
    return F.array_join(F.map_values(values), " ")


def list_text(values: Column) -> Column:
    return F.array_join(values, " ")


def rows_of(**columns: Column) -> Column:
    """A generator of rows from arrays side by side; a shorter one gives nulls."""
    return F.inline(F.arrays_zip(*(c.alias(n) for n, c in columns.items())))


def patch_json(document: Column, schema: str, changes: dict[str, Column | None]) -> Column:
    """A JSON text with some fields set, or dropped where the change is None; ``schema`` lists all its fields."""
    value = F.from_json(document, schema)
    for name, change in changes.items():
        value = value.dropFields(name) if change is None else value.withField(name, change)
    return F.to_json(value)
