"""Prices as pages write them, in either convention for thousands and decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let

# The forms of amounts that results depend on.
#: The first number, a grouped form first.
AMOUNT = "(?i)([0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)"


def normalize_price(text: Column) -> Column:
    """The amount as written, without currency; null if there is none."""
    return F.nullif(F.regexp_extract(clean_text(text), AMOUNT, 1), F.lit(""))


def parse_price(text: Column) -> Column:
    """The amount as a number: of two kinds of marks the last one is the decimal mark; one kind is it before one or two digits."""
    return let(normalize_price(text), parse_amount)


def parse_amount(amount: Column) -> Column:
    """``parse_price`` of what ``normalize_price`` gives."""
    comma, dot = F.length(amount) - F.instr(F.reverse(amount), ","), F.length(amount) - F.instr(F.reverse(amount), ".")
    without = lambda mark: F.replace(amount, F.lit(mark), F.lit(""))
    decimal_comma = F.replace(without("."), F.lit(","), F.lit("."))
    both = F.contains(amount, F.lit(",")) & F.contains(amount, F.lit("."))
    number = (
        F.when(both & (comma > dot), decimal_comma)
        .when(both, without(","))
        .when(amount.rlike(",[0-9]{1,2}$"), decimal_comma)
        .when(amount.rlike("\\.[0-9]{1,2}$"), amount)
        .otherwise(F.regexp_replace(amount, "[.,]", ""))
    )
    return number.try_cast("double")


def price_sort_key(text: Column) -> Column:
    """The number by which inventories are sorted: whole-text forms, else all digits. It can differ from ``parse_price``."""
    value = F.trim(text)
    drop = lambda marks: F.regexp_replace(value, f"[{marks}]", "")
    number = (
        F.when(value.rlike("^[0-9.,]+,[0-9]{1,2}$") & F.contains(value, F.lit(".")), F.replace(drop("."), F.lit(","), F.lit(".")))
        .when(value.rlike("^[0-9.,]+\\.[0-9]{1,2}$") & F.contains(value, F.lit(",")), drop(","))
        .when(value.rlike("^[0-9]+,[0-9]{1,2}$"), F.replace(value, F.lit(","), F.lit(".")))
        .when(value.rlike("^[0-9]+\\.[0-9]{1,2}$"), value)
        .when(value.rlike("^[0-9]{1,3}(\\.[0-9]{3})+$"), drop("."))
        .when(value.rlike("^[0-9]{1,3}(,[0-9]{3})+$"), drop(","))
        .otherwise(drop("^0-9"))
    )
    return F.nullif(number, F.lit("")).try_cast("decimal(38,6)")


def infer_currency(explicit: Column, text: Column, default: Column | None = None) -> Column:
    """A given code in capitals, else what the price's signs say, else the default."""
    given = F.upper(clean_text(explicit))
    signs = F.when(text.rlike("(?i)US\\$|U\\$S|USD"), "USD").when(text.rlike("(?i)\\$U|UYU|\\$"), "UYU")
    return F.coalesce(given, signs, default if default is not None else F.lit(None).cast("string"))


def _digits(text: Column, signs: str) -> Column:
    """The first run of digits and marks, currency signs and white space out of the way."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.regexp_replace(clean_text(text), f"(?i){signs}", ""), "\\s+", ""), "([0-9][0-9.,]*)", 1), F.lit(""))


def dotted_price(text: Column) -> Column:
    """The amount with a decimal point, of sites that write thousands with points and decimals with a comma; other forms stay as ``normalize_price`` has them."""

    def plain(number: Column) -> Column:
        whole, cents = F.regexp_extract(number, "^(.*?)(?:,([0-9]{1,2}))?$", 1), F.nullif(F.regexp_extract(number, ",([0-9]{1,2})$", 1), F.lit(""))
        joined = lambda x: F.concat_ws(".", x, cents)
        return (
            F.when(~F.contains(whole, F.lit(".")), joined(whole))
            .when(whole.rlike("^[0-9]{1,3}(?:\\.[0-9]{3})+$"), joined(F.replace(whole, F.lit("."), F.lit(""))))
            .otherwise(normalize_price(text))
        )

    return let(_digits(text, "\\$U|\\$|UYU"), lambda n: F.when(n.isNotNull(), plain(n)))


def portal_price(text: Column) -> Column:
    """The amount with a decimal point: a comma before one or two digits at the end is decimal, points in threes are thousands."""
    drop = lambda x: F.replace(x, F.lit("."), F.lit(""))
    plain = lambda n: (
        F.when(n.rlike(",[0-9]{1,2}$"), F.concat_ws(".", drop(F.regexp_extract(n, "^(.*),[0-9]{1,2}$", 1)), F.regexp_extract(n, ",([0-9]{1,2})$", 1)))
        .when(n.rlike("^[0-9]{1,3}(?:\\.[0-9]{3})+$"), drop(n))
        .otherwise(F.regexp_replace(n, "^([^,]*),", "$1."))
    )
    return let(_digits(text, "US\\$|\\$U|\\$|UYU|USD"), lambda n: F.when(n.isNotNull(), plain(n)))
