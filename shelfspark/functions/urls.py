"""URLs as keys, by expressions on their text."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import unaccent

_HTTP = "(?i)^https?://[^/?#\\s]+"


def is_http(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(_HTTP), F.lit(False))


def hostname(url: Column) -> Column:
    """In lower case without port, user and ``www.``; null if the text is no http address."""
    host = F.regexp_extract(F.lower(F.trim(url)), "^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.nullif(host, F.lit("")), "^www\\.", "")


def path_of(url: Column) -> Column:
    """The path in lower case, ``/`` if there is none; null if the text is no http address."""
    path = F.regexp_extract(F.lower(F.trim(url)), "^https?://[^/?#]+([^?#]*)", 1)
    return F.when(is_http(url), F.when(path == "", "/").otherwise(path))


def query_of(url: Column) -> Column:
    """The query with its question mark in lower case, or the empty string."""
    return F.regexp_extract(F.lower(F.trim(url)), "^[^?#]*(\\?[^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Key of a product: no fragment, no ``www.``, no default port, no slash at the path's end, all in lower case; null if no http address."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    bare = F.regexp_replace(bare, "^(https?://)www\\.", "$1")
    bare = F.regexp_replace(bare, "^(http://[^/?]+?):80(?=[/?]|$)|^(https://[^/?]+?):443(?=[/?]|$)", "$1$2")
    return F.when(is_http(url), F.regexp_replace(bare, "/+(\\?|$)", "$1"))


def catalog_url(url: Column) -> Column:
    """Address to fetch: no fragment, no tracking parameters, host in lower case, no default port; the path stays as it is."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.concat(F.lower(F.regexp_extract(bare, "^([a-zA-Z]+://[^/?]+)", 1)), F.regexp_replace(bare, "^[a-zA-Z]+://[^/?]+", ""))
    bare = F.regexp_replace(bare, "^(http://[^/?]+?):80(?=[/?]|$)|^(https://[^/?]+?):443(?=[/?]|$)", "$1$2")
    kept = F.regexp_replace(bare, "(?i)(?<=[?&])(?:utm_[^=&]*|mc_[^=&]*|fbclid|gclid)(?:=[^&]*)?(?:&|$)", "")
    return F.when(is_http(url), F.regexp_replace(kept, "[?&]+$", ""))


def without_query(url: Column) -> Column:
    """Canonical form of sites whose query does not name a product."""
    return F.regexp_replace(canonical_url(url), "/*\\?.*$", "")


def inventory_host(site: Column) -> Column:
    """The host by which inventories are filtered and counted: scheme, path and ``www.`` go."""
    return F.regexp_replace(F.split_part(F.replace(F.replace(F.lower(site), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1)), "^www\\.", "")


def site_key(site: Column) -> Column:
    """File-name key of a listing: host and path, without a page number at the end."""
    key = lambda x: F.lower(F.regexp_replace(F.regexp_replace(unaccent(x), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    path = key(F.regexp_replace(path_of(site), "(?i)/page-[0-9]+/?$", "/"))
    other = key(site)
    return F.when(is_http(site), F.when(path == "", hostname(site)).otherwise(F.concat_ws("_", hostname(site), path))).otherwise(F.when(other == "", "unknown-site").otherwise(other))


def page_urls(base: Column, pages: Column, parameter: str = "page") -> Column:
    """Addresses of the pages 1 to ``pages`` of a listing, by a parameter."""
    joint = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return F.transform(F.sequence(F.lit(1), F.greatest(pages, F.lit(1)).cast("int")), lambda n: F.when(n == 1, base).otherwise(F.concat(base, joint, F.lit(f"{parameter}="), n.cast("string"))))


def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            out = urljoin(b or "", (x or "").strip())
        except ValueError:
            return None
        return out if x and out.lower().startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def resolve_url(base: Column, link: Column) -> Column:
    """A link as an absolute address, as browsers resolve it; null if that is no http address. Runs in Python by batches."""
    return F.pandas_udf(_resolved, StringType())(base, link)


def widest_source(srcset: Column) -> Column:
    """Of a srcset's candidates the one with the largest width or density; of equals the last in order of text."""
    parts = F.transform(F.split(srcset, ",\\s+|,$"), lambda x: F.struct(F.coalesce(F.regexp_extract(x, "\\s([0-9.]+)[wx]\\s*$", 1).try_cast("double"), F.lit(0.0)).alias("width"), F.regexp_extract(F.trim(x), "^(\\S+)", 1).alias("url")))
    return F.array_max(F.filter(parts, lambda p: p["url"] != ""))["url"]
