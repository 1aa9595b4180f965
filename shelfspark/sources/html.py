"""Stored pages as arrays of elements, and records from pages by selectors.

Parsing is the one step in Python. Records of cards and details take values that selectors
find in that same pass (``selectors``). Where elements themselves are wanted, a page becomes
one row with its text and its elements (number, number of the last descendant, parent, tag,
id, classes, attributes, and which part of the page's text is the element's), and selectors
are functions of these arrays. Either way a page is read where it lies, nothing is shuffled
or joined, and pages that are stored twice or have no address do not mix.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, urls
from ..functions.text import clean_text, let
from .selectors import VOID, Boxes, Request, Tags, Ways, cards, of_pages

NODE = "struct<node:int,last:int,parent:int,depth:int,tag:string,id:string,classes:array<string>,attributes:map<string,string>,begin:int,size:int,raw:string>"
PAGE = f"struct<text:string,nodes:array<{NODE}>>"
#: The parsed page beside a page's own columns.
PARSED = "_page"


class _Elements(Tags):
    """Elements in page order; each one's text is the part of the page's text between its tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[int] = []
        self.words: list[str] = []
        self.size = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        at = len(self.rows)
        self.rows.append({"node": at, "last": at, "parent": self.stack[-1] if self.stack else -1, "depth": len(self.stack), "tag": tag, "id": values.get("id"), "classes": values.get("class", "").split(), "attributes": list(values.items()), "begin": self.size, "size": 0, "raw": None})
        if tag not in VOID:
            self.stack.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(self.stack.pop())

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]]["tag"] == tag:
                for at in self.stack[i:]:
                    self._close(at)
                del self.stack[i:]
                return

    def _close(self, at: int) -> None:
        row = self.rows[at]
        row["last"], row["size"] = len(self.rows) - 1, self.size - row["begin"]

    def handle_data(self, data: str) -> None:
        own = self.rows[self.stack[-1]] if self.stack else None
        if own and own["tag"] in ("script", "style"):
            own["raw"] = (own["raw"] or "") + data
            return
        for word in data.split():
            self.words.append(word)
            self.size += len(word) + 1

    def close(self) -> None:
        super().close()
        for at in self.stack:
            self._close(at)
        self.stack.clear()


def _parsed(page: str | None) -> dict:
    parser = _Elements()
    parser.feed(page or "")
    parser.close()
    return {"text": "".join(w + " " for w in parser.words), "nodes": parser.rows}


_NODE_TYPE = pa.struct([("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("size", pa.int32()), ("raw", pa.string())])
_PAGE_TYPE = pa.struct([("text", pa.string()), ("nodes", pa.list_(_NODE_TYPE))])


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the parsed page; null and empty pages have no elements."""
    return pages.withColumn(PARSED, of_pages(F.col(html), _PAGE_TYPE, PAGE, _parsed))


def nodes() -> Column:
    return F.col(f"{PARSED}.nodes")


def text_of(node: Column) -> Column:
    """The text of an element, white space collapsed; null if it has none. Scripts and styles have no text."""
    return F.nullif(F.rtrim(F.substr(F.col(f"{PARSED}.text"), node["begin"] + 1, node["size"])), F.lit(""))


def attribute(node: Column, name: str) -> Column:
    return clean_text(F.try_element_at(node["attributes"], F.lit(name)))


_PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:([*^$]?=)[\"']?([^\]\"']*)[\"']?)?\]")


def matches(selector: str, node: Column) -> Column:
    """A predicate on an element: ``tag``, ``.class``, ``#id``, ``[name]``, ``[name=v]``, ``[name*=v]``, ``[name^=v]``, ``[name$=v]``, joined."""
    tag = re.match(r"[\w*-]*", selector)[0]
    test = F.lit(True) if tag in ("", "*") else node["tag"] == tag
    for mark, value, name, how, text in _PART.findall(selector):
        held = F.try_element_at(node["attributes"], F.lit(name)) if name else None
        if mark == ".":
            test = test & F.array_contains(node["classes"], value)
        elif mark == "#":
            test = test & F.coalesce(node["id"] == value, F.lit(False))
        elif not how:
            test = test & held.isNotNull()
        else:
            test = test & F.coalesce({"=": held == text, "*=": held.contains(text), "^=": held.startswith(text), "$=": held.endswith(text)}[how], F.lit(False))
    return test


def inside(node: Column, box: Column) -> Column:
    return node["node"].between(box["node"], box["last"])


def _one(selector: str, of: Column) -> Column:
    """Elements that a selector without commas finds; each further part lies inside what the parts before found."""
    part, _, rest = selector.strip().partition(" ")
    found = F.filter(of, lambda n: matches(part, n))
    return _deeper(rest.strip(), of, found) if rest else found


def _deeper(selector: str, of: Column, outer: Column) -> Column:
    part, _, rest = selector.partition(" ")
    found = let(outer, lambda boxes: F.filter(of, lambda n: matches(part, n) & F.exists(boxes, lambda o: (o["node"] < n["node"]) & inside(n, o))))
    return _deeper(rest.strip(), of, found) if rest else found


def select(selector: str, of: Column | None = None) -> Column:
    """The page's elements that any of the selectors (after commas) finds, in page order."""
    of = nodes() if of is None else of
    each = [_one(x, of) for x in selector.split(",")]
    if len(each) == 1:
        return each[0]
    places = F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda n: n["node"]) for x in each))))
    return F.transform(places, lambda i: F.get(of, i))


def elements(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The elements of each page as rows in page order, with the page's row number. Scripts carry their source in ``raw``."""
    parsed = parse(pages.select(F.monotonically_increasing_id().alias("page"), F.col(url).alias("url"), F.col(html).alias("html")))
    each = F.transform(nodes(), lambda n: F.struct(*(n[c].alias(c) for c in ("node", "last", "parent", "depth", "tag", "id", "classes", "attributes")), F.when(~n["tag"].isin("script", "style"), F.coalesce(text_of(n), F.lit(""))).alias("text"), n["raw"].alias("raw")))
    return parsed.select("page", "url", F.inline(each))


#: Fallbacks for listing cards and for detail pages.
CARD_FIELDS: dict[str, Ways] = {
    "link": [("a[href]", "href")],
    "product_name": [("h2", "text"), ("h3", "text"), (".title", "text"), ("[class*=name]", "text"), ("a[title]", "title"), ("a", "text")],
    "price_text": [(".price", "text"), ("[class*=price]", "text"), ("[class*=precio]", "text"), ("p", "text"), ("div", "text")],
    "image": [("img[data-src]", "data-src"), ("img[src]", "src")],
    "state_text": [("[class*=stock]", "text"), ("button", "text"), ("[class*=agotado]", "text")],
    "sku": [("[class*=sku]", "text"), ("[data-codprod]", "data-codprod")],
}
DETAIL_FIELDS: dict[str, Ways] = {
    "product_name": [("h1", "text"), ("[itemprop=name]", "text"), ("meta[property=og:title]", "content"), ("title", "text")],
    "price_text": [("[itemprop=price]", "content"), ("[itemprop=price]", "text"), (".price", "text"), ("[class*=price]", "text"), ("[class*=precio]", "text")],
    "image": [("meta[property=og:image]", "content"), ("main img", "src"), ("img[src]", "src")],
    "description": [("[itemprop=description]", "text"), ("[class*=description]", "text"), ("meta[name=description]", "content")],
    "sku": [(".sku", "text"), ("[itemprop=sku]", "text"), ("[class*=sku]", "text"), ("[class*=codigo]", "text")],
    "state_text": [("[class*=stock]", "text"), ("form button", "text")],
}
# What a missing page says.
MISSING_PAGE = "404|page not found|not found|pagina no encontrada|no se ha podido encontrar"
# What a missing page has as its name; the number alone may be part of a telephone number or a code.
MISSING_NAME = "(?:^\\W*|\\berror\\W*)404\\b|\\b404\\W+(?:error|not found|no)\\b|pagina no encontrada|página no encontrada|page not found"


def _records(page: Column, link: Column, state: Column, fields: list[str]) -> list[Column]:
    """The columns of a product record, of the fields found for a card."""
    amount = F.col("price_text")
    have = lambda c: F.col(c) if c in fields else F.lit(None).cast("string")
    return [
        F.col("product_name"),
        price.normalize_price(amount).alias("price"),
        price.infer_currency(F.lit(None).cast("string"), amount).alias("currency"),
        have("sku").alias("sku"),
        state.alias("availability"),
        link.alias("source_url"),
        urls.catalog_url(urls.resolve_url(page, F.col("image"))).alias("image_url"),
        *(F.col(c) for c in fields if c not in ("link", "product_name", "price_text", "image", "state_text", "sku")),
        page.alias("page_url"),
        F.col("card"),
    ]


def known_state(text: Column) -> Column:
    """What a text says of availability; null if nothing."""
    from ..operators.quality import availability

    return F.nullif(availability(text), F.lit("unknown"))


def listing_products(pages: DataFrame, card_selector: str, fields: dict[str, Ways] | None = None, needs_price: bool = True) -> DataFrame:
    """A record per card with an address and a name (and a price where it is needed)."""
    from ..operators.quality import availability

    ways = CARD_FIELDS | (fields or {})
    found = cards(pages, Request(Boxes(card_selector), ways))
    link = urls.catalog_url(urls.resolve_url(F.col("url"), F.col("link")))
    out = found.select(*_records(F.col("url"), link, F.when(F.col("state_text").isNotNull(), availability(F.col("state_text"))), list(ways)))
    kept = out.where(F.col("product_name").isNotNull() & F.col("source_url").isNotNull())
    return kept.where(F.col("price").isNotNull()) if needs_price else kept


def detail_products(pages: DataFrame, fields: dict[str, Ways] | None = None) -> DataFrame:
    """A record per page with a name; pages that say they do not exist give none."""
    from ..operators.quality import availability

    ways = DETAIL_FIELDS | (fields or {})
    found = cards(pages, Request(Boxes(), ways))
    state = availability(F.concat_ws(" ", "state_text", "description"))
    out = found.select(*_records(F.col("url"), urls.catalog_url(F.col("url")), state, list(ways)))
    return out.where(F.col("product_name").isNotNull() & ~F.lower("product_name").rlike(MISSING_NAME))


def embedded_json(nodes: DataFrame, kind: str = "application/ld+json") -> DataFrame:
    """(url, node, body): the JSON scripts of pages, of their elements."""
    return nodes.where((F.col("tag") == "script") & (F.try_element_at("attributes", F.lit("type")) == kind)).select("url", "node", F.col("raw").alias("body"))


def label_values(nodes: DataFrame) -> DataFrame:
    """(url, values map): the pairs of definition lists and two-cell table rows of each page, of their elements; the first value of a label wins."""
    cells = nodes.where(F.col("tag").isin("dt", "th", "dd", "td")).groupBy("page", "url").agg(F.array_sort(F.collect_list(F.struct("node", "parent", "tag", "text"))).alias("cells"))
    after = lambda n: F.filter("cells", lambda v: v["tag"].isin("dd", "td") & (v["parent"] == n["parent"]) & (v["node"] > n["node"]))
    pair = lambda n: F.struct(F.regexp_replace(n["text"], ":\\s*$", "").alias("label"), F.get(after(n), F.lit(0))["text"].alias("value"))
    pairs = F.transform(F.filter("cells", lambda n: n["tag"].isin("dt", "th")), pair)
    known = F.filter(pairs, lambda p: (p["label"] != "") & (F.coalesce(p["value"], F.lit("")) != ""))
    first = let(known, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["label"] == p["label"])))
    return cells.select("url", F.map_from_entries(first).alias("values")).where(F.size("values") > 0)


def brand_seeds(pages: DataFrame, link_pattern: str) -> DataFrame:
    """(url, seed, label, place): links or options whose address fits, each address once, with the first label that is known."""
    found = elements(pages).where(F.col("tag").isin("a", "option"))
    target = urls.catalog_url(urls.resolve_url(F.col("url"), F.coalesce(F.try_element_at("attributes", F.lit("href")), F.try_element_at("attributes", F.lit("value")))))
    seeds = found.withColumn("seed", target).where(F.col("seed").rlike(link_pattern))
    label = clean_text(F.col("text"))
    return seeds.groupBy("url", "seed").agg(F.min_by(label, F.when(label.isNotNull(), F.col("node"))).alias("label"), F.min("node").alias("place"))
