"""Work is dealt to all cores, pages are Python's objects a few at a time, and large tables are not broadcast."""

import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from shelfspark.operators import categories
from shelfspark.plans import registry
from shelfspark.shared import spread
from shelfspark.sources import html, selectors


@pytest.mark.parametrize("name", ["best_names", "embedded_products", "detail_pages", "compatibility_lists", "quality_gate", "page_summaries"])
def test_short_tables_are_tasks_for_all_cores(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_that_come_from_few_rows_are_tasks_for_all_cores(spark, sf_dir):
    plan = registry.queries()["rendered_pages"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == 32


def test_pages_are_objects_a_few_at_a_time(spark):
    short, long = pa.array(["<p>x"] * 1000 + [None]), pa.array(["x" * 600_000] * 5)
    sizes = [len(x) for x in selectors._slices(short)]
    assert sum(sizes) == 1001 and max(sizes) <= 64 and [len(x) for x in selectors._slices(long)] == [2, 2, 1]
    pages = spark.range(300).selectExpr("cast(id as string) url", "concat('<article><a href=\"/p/', id, '\">n', id, '</a></article>') html").coalesce(1)
    found = selectors.cards(pages, selectors.Request(selectors.Boxes("article"), {"link": [("a[href]", "href")], "name": [("a", "text")]}))
    assert {(r.url, r.link, r.name) for r in found.collect()} == {(str(i), f"/p/{i}", f"n{i}") for i in range(300)}
    assert html.elements(pages).where("tag = 'a'").selectExpr("url = substring(text, 2, 9) same").where("same").count() == 300


def test_trees_are_not_broadcast(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "key string, parent string, label string")
    tree = categories.tree(nodes)
    assert "Broadcast" not in tree._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.depth, "/".join(r.path)) for r in tree.collect()} == {("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C")}


def test_names_that_hold_404(spark):
    names = {"Bomba +1 (404) 555-9676": True, "Filtro 404": True, "404 no": False, "Error 404": False, "Oops: 404 not found": False, "Página no encontrada": False}
    pages = spark.createDataFrame([(f"https://a.example/{i}", f"<h1>{n}</h1>") for i, n in enumerate(names)], "url string, html string")
    assert {r.product_name for r in html.detail_products(pages).collect()} == {n for n, kept in names.items() if kept}


def test_references_of_page_details(spark, tmp_path):
    """The query's SQL knows three references; any other is text."""
    spark.createDataFrame([(1, "u", "<h1>a = &quot;b &lt;i&gt; &amp;lt; c&amp</h1>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert registry.queries()["page_details"](spark, str(tmp_path)).first().product_name == "a = &quot;b <i> &lt; c&amp"


class _Seen:
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.seen.append((tag, attrs, "/"))

    def handle_endtag(self, tag):
        self.seen.append(tag)

    def handle_data(self, data):
        self.seen.append(("", data))


def test_plain_tags_are_read_as_the_standard_parser_reads_them():
    class Ours(_Seen, selectors.Tags):
        pass

    class Standard(_Seen, HTMLParser):
        pass

    of = random.Random(5)
    parts = ["<", ">", "/", '"', "'", "=", " ", "\n", "&amp;", "&lt", "a", "b", "É", "-", "!--", "<a ", "</a>", '<a href="x">', '<p class="c d" ID="7">', "<br/>", "<B>", '<i x="1" x="2">', '<i t="a>b<c">', '<i t="&amp;">', "<script>", "</script>", "<style >", "</style>", "<title>", "</title>", "<textarea>", "</textarea>", "<td\t>", "</p >", '<p a="1"b="2">', "<p a=1>", '<p a="">', "<p a>", "</"]
    for _ in range(20_000):
        page = "".join(of.choice(parts) for _ in range(of.randrange(1, 14)))
        both = []
        for kind in (Ours, Standard):
            parser = kind()
            parser.feed(page)
            parser.close()
            both.append(parser.seen)
        assert both[0] == both[1], page


def test_plain_tags_are_not_taken_apart_twice(monkeypatch):
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", None)
    assert len(selectors.Walk(selectors.Selectors(["a[href]"]), 1, '<ul class="x"><li><a href="/a">b</a></li></ul>').found[0]) == 1
