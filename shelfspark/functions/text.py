"""Text normalisation as column expressions, so that plans stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers understand it: ASCII, no-break space, byte order mark and the Unicode spaces.
SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: functions of arrays would compute it again for each of their entries."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter and marks, and these letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code) and len(base) == 1 and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def unaccent(text: Column) -> Column:
    """Latin letters without their accents; combining marks go."""
    return F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), ACCENTED, PLAIN)


def clean_text(text: Column) -> Column:
    """Runs of white space as one space, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, SPACES, " ")), F.lit(""))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 read as Latin-1: the lower-case Spanish letters and some signs."""
    for good in "áéíóúüñÁÉÍÓÚÜÑ¿¡°":
        text = F.replace(text, F.lit(good.encode().decode("latin-1")), F.lit(good))
    return text


def fold(text: Column) -> Column:
    """For comparisons: repaired, lower case, without accents, white space collapsed; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(unaccent(F.lower(repair_mojibake(text))), SPACES, " ")), F.lit(""))


def plain(text: str) -> str:
    """``fold`` of a constant. Runs on the driver."""
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower().split())


def search_text(*fields: Column) -> Column:
    """What searches look in: non-empty fields in lower case, all but a-z and 0-9 as a space, doubled letters once."""
    joined = F.concat_ws(" ", *(F.nullif(f, F.lit("")) for f in fields))
    single = F.regexp_replace(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " "), "([a-z])\\1+", "$1")
    return F.trim(F.regexp_replace(single, " +", " "))


def search_tokens(text: str) -> list[str]:
    """A search's words, normalised as ``search_text``, those of one character left out. Runs on the driver."""
    import re

    found = (re.sub(r"([a-z])\1+", r"\1", re.sub(r"[^a-z0-9]+", " ", t)).strip() for t in text.lower().split())
    return [t for t in found if len(t) >= 2]


def plain_key(text: Column) -> Column:
    """Letters a-z and digits, without accents, others as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccent(text)), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.replace(plain_key(text), F.lit(" "), F.lit("-"))


def padded(key: Column) -> Column:
    """A plain key with a space at either end, so that a padded phrase is found as whole words."""
    return F.concat(F.lit(" "), key, F.lit(" "))


def brand_from_text(text: Column) -> Column:
    """The first short part of a name that is cut by a dash, bar or slash."""
    parts = F.transform(F.split(text, "\\s+[-|/]\\s+|\\|"), lambda x: clean_text(x))
    return F.get(F.filter(parts, lambda x: x.isNotNull() & (F.length(x) <= 40)), F.lit(0))


def label_case(text: Column) -> Column:
    """Words of a label with capitals, dashes and underscores as spaces."""
    return F.initcap(clean_text(F.regexp_replace(text, "[-_]+", " ")))


def labelled_value(text: Column, label: str, others: list[str]) -> Column:
    """The value after ``label:`` up to the next of the other labels, or null."""
    stop = "|".join(others) or "(?!)"
    return clean_text(F.nullif(F.regexp_extract(text, f"(?is)\\b(?:{label})\\s*:\\s*(.*?)\\s*(?=\\b(?:{stop})\\s*:|$)", 1), F.lit("")))


def first_number(text: Column, pattern: str) -> Column:
    """The digits of the first group of ``pattern`` as a long, thousands marks ignored; null without a match."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), "[^0-9]", "").try_cast("bigint")


def redact(text: Column, names: tuple[str, ...] = ("password", "passwd", "token", "secret", "authorization", "cookie", "session")) -> Column:
    """Values of parameters and JSON fields with secret names, replaced by a mark."""
    keys = "|".join(names)
    out = F.regexp_replace(text, f'(?i)("[^"]*(?:{keys})[^"]*"\\s*:\\s*")[^"]*', "$1[REDACTED]")
    return F.regexp_replace(out, f"(?i)\\b([\\w.-]*(?:{keys})[\\w.-]*=)[^&\\s;#]+", "$1[REDACTED]")


#: Names of characters that markup uses for its own signs, and for a space.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_NUMBERED = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _character(reference: Column) -> Column:
    """The character of a numbered reference; the reference itself if there is none."""
    number = F.substring(reference, 3, 8)
    digits = F.replace(number, F.lit(";"), F.lit(""))
    code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")).otherwise(reference)


def decode_entities(text: Column) -> Column:
    """Named (markup's own, and the space) and numbered character references, each decoded once."""
    # An ampersand that is itself written as a reference begins no other one: these come last.
    amp = "(?i)&(?:amp|#0*38|#x0*26);"
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0))), lambda x: ~x.rlike(amp))
    out = F.aggregate(found, text, lambda acc, x: F.replace(acc, x, _character(x)))
    for name, sign in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", sign)
    return F.regexp_replace(out, amp, "&")


def strip_tags(html: Column) -> Column:
    """Text of a small piece of markup: tags go, references are decoded."""
    return clean_text(decode_entities(F.regexp_replace(html, "(?s)<[^>]*>", " ")))
