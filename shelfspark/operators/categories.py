"""A portal's categories: references in its pages, and the tree they are, with paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import clean_text
from ..shared import drop_tables, write_table
from ..sources import selectors

# A category's parameters, from the widest to the narrowest, and a filter beside them; names of its levels.
PARAMETERS = ("id_category", "id_subcategory", "id_subsubcategory")
FILTER = "option_filter"
LEVELS = {"id_subsubcategory": "subsubcategory", "id_subcategory": "subcategory", "id_category": "category"}
SHORT = {"id_category": "cat", "id_subcategory": "sub", "id_subsubcategory": "subsub", "option_filter": "opt"}
#: Attributes that hold a parameter, in turn.
HELD = {p: (f"data-{p}", f"data-{p.replace('_', '-')}", f"data-{p.removeprefix('id_')}") for p in PARAMETERS} | {FILTER: (f"data-{FILTER}", f"data-{FILTER.replace('_', '-')}")}
#: Options of these selects are numbers of categories.
OPTIONS = {"id_subsubcategory": "select[name*=subsub] option[value]", "id_subcategory": "select[name*=sub] option[value]", "id_category": "select[name*=categor] option[value]"}
PRODUCT_PATH = "(?i)^https?://[^/?#]+/(?:[^?#]*/)?productos/([^/?#]+)/([^/?#]+)/([0-9]+)/[^/?#]+"
QUERIES = "(?i)load-data-search\\.php\\?([^\"'`<>{}?]*)"


def category_key(values: dict[str, Column]) -> Column:
    """``cat:1|sub:2|subsub:|opt:``: the key of a category by its parameters."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{SHORT[p]}:"), F.coalesce(values[p], F.lit(""))) for p in (*PARAMETERS, FILTER)))


def category_refs(pages: DataFrame) -> DataFrame:
    """(key, name, url, id_category, id_subcategory, id_subsubcategory, option_filter, level, parent_key) of the categories that pages (url, html) refer to.

    Links, options of named selects, elements with data attributes, and queries inside of scripts
    count. A category is known once, by its last reference on the last page in order of
    addresses; ``parent_key`` leaves out its narrowest parameter.
    """
    attributes = [a for names in HELD.values() for a in names]
    marked = ", ".join(["a[href]", *(f"[{a}]" for a in attributes)])
    column = lambda a: a.replace("-", "_")
    asked = {"refs": (marked, {"href": "href", "label": "text", **{f"a_{column(a)}_{i}": a for i, a in enumerate(attributes)}}), **{p: (s, {"value": "value", "label": "text"}) for p, s in OPTIONS.items()}}
    found = selectors.find(pages.select("url", "html"), asked)
    place = {a: f"a_{column(a)}_{i}" for i, a in enumerate(attributes)}

    def of_element(n: Column) -> Column:
        href = n["href"]
        parameter = lambda p: F.nullif(F.regexp_extract(href, f"[?&]{p}=([0-9]+)", 1), F.lit(""))
        own = {p: F.coalesce(parameter(p), *(F.nullif(F.regexp_extract(n[place[a]], "^([0-9]+)", 1), F.lit("")) for a in names)) for p, names in HELD.items()}
        return F.struct(n["node"].alias("node"), href.alias("href"), n["label"].alias("label"), *(own[p].alias(p) for p in own))

    def of_option(p: str) -> Column:
        narrower = list(OPTIONS)[: list(OPTIONS).index(p)]
        taken = lambda n: F.exists(F.concat(*(F.col(f"_found.{x}") for x in narrower)), lambda o: o["node"] == n["node"]) if narrower else F.lit(False)
        options = F.filter(f"_found.{p}", lambda n: n["value"].rlike("^[0-9]+$") & ~taken(n))
        none = F.lit(None).cast("string")
        return F.transform(options, lambda n: F.struct(n["node"].alias("node"), none.alias("href"), n["label"].alias("label"), *((n["value"] if q == p else none).alias(q) for q in HELD)))

    queries = F.regexp_extract_all("html", F.lit(QUERIES), F.lit(1))

    def of_query(q: Column, i: Column) -> Column:
        parameter = lambda p: F.nullif(F.regexp_extract(q, f"(?:^|[&;]){p}=([0-9]+)", 1), F.lit(""))
        return F.struct((i + 2**30).cast("int").alias("node"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("label"), *(parameter(p).alias(p) for p in HELD))

    each = F.concat(F.transform("_found.refs", of_element), *(of_option(p) for p in OPTIONS), F.transform(queries, of_query))
    rows = found.select("url", F.explode(each).alias("r")).select("url", "r.*").withColumn("target", urls.resolve_url(F.col("url"), F.col("href")))
    # A product's address names its category by number and in words.
    numbered = F.nullif(F.regexp_extract("target", PRODUCT_PATH, 3), F.lit(""))
    in_path = F.col("id_subsubcategory").isNull() & numbered.isNotNull()
    words = clean_text(F.try_url_decode(F.regexp_extract("target", PRODUCT_PATH, 2)))
    rows = rows.withColumns({"id_subsubcategory": F.coalesce("id_subsubcategory", numbered), "name": F.coalesce(clean_text(F.col("label")), F.when(in_path, words))})
    values = {p: F.col(p) for p in (*PARAMETERS, FILTER)}
    level = F.coalesce(*(F.when(F.col(p).isNotNull(), name) for p, name in LEVELS.items()), F.lit("leaf"))
    known = rows.where(F.coalesce(*values.values()).isNotNull()).select(category_key(values).alias("key"), "name", F.col("target").alias("page"), *values, level.alias("level"), F.struct("url", "node").alias("place"))
    last = known.groupBy("key").agg(F.max_by(F.struct("name", "page", *values, "level"), "place").alias("r")).select("key", "r.name", F.col("r.page").alias("url"), *(f"r.{p}" for p in values), "r.level")
    narrowest = F.coalesce(*(F.when(F.col(p).isNotNull(), p) for p in (FILTER, *reversed(PARAMETERS))))
    above = {p: F.when(narrowest != p, F.col(p)) for p in values}
    return last.withColumn("parent_key", F.when(F.coalesce(*above.values()).isNotNull(), category_key(above)))


def tree(nodes: DataFrame) -> DataFrame:
    """(key, depth, root, path) of ``nodes`` (key, parent, label): labels from the root down; what runs in a circle, or hangs from one, has nulls.

    Each round joins every node with what is known of the one that it hangs from, which doubles
    how far it sees: a tree of depth d takes log2(d) rounds, first without labels to find who
    sees a root, then with the labels of these alone. A node whose parent is not there is a
    root. Rounds are tables, so a parent of very many nodes is a skewed join that can be split; both
    sides are as many as the nodes, so neither is ever broadcast, however few bytes its file has.
    """
    known = nodes.select(F.col("key").alias("parent")).distinct().withColumn("known", F.lit(True))
    start = write_table(nodes.join(known.hint("merge"), "parent", "left").select("key", F.when(F.col("known"), F.col("parent")).alias("up"), "label"), "tree-nodes")
    most = max(1, start.count()).bit_length() + 1
    seen = _climbed(start.select("key", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), most, {"depth": lambda own, above: own + above})
    rooted = seen.where("up is null").select("key", "depth")
    own = start.join(rooted.select("key").hint("merge"), "key", "left_semi").select("key", "up", F.array("label").alias("path"), F.col("key").alias("root"))
    paths = _climbed(own, most, {"path": lambda own, above: F.concat(above, own), "root": lambda own, above: above})
    found = rooted.join(paths.drop("up").hint("merge"), "key").select("key", F.col("depth").cast("int").alias("depth"), "root", "path")
    none = start.join(rooted.hint("merge"), "key", "left_anti").select("key", *(F.lit(None).cast(t).alias(c) for c, t in found.dtypes[1:]))
    return found.unionAll(none)


def _climbed(state: DataFrame, rounds: int, joined: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``state`` (key, up, others) once each node has seen its root, whose ``up`` is null, or after so many rounds; ``joined``: others from a node's own and its ancestor's."""
    state = write_table(state, "tree")
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(*(F.col(c).alias(f"_{c}") for c in state.columns))
        seen = state.where("up is not null").join(above.hint("merge"), F.col("up") == F.col("_key")).select("key", F.col("_up").alias("up"), *(f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in joined.items()))
        before, state = state, write_table(state.where("up is null").unionAll(seen), "tree")
        drop_tables(before)
    return state
