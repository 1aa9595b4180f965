import json

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import arrays, names
from shelfspark.operators import inventory, jobs
from shelfspark.operators.rules import SiteRule
from shelfspark.schema import conform
from shelfspark.sources import json_trees


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "name"),
    [(" Óptica  Corsa - Yokomitsu ", "Óptica Corsa"), ("FARO '2004 - DERECHO", "FARO 2004 - DERECHO"), ("Faro – yokomitsuparts.com.uy", "Faro"), ("Ver  detalle", None), ("abcd", None), ("Abc", None), ("A" * 181, None), ("$.ajax Name", None), (None, None)],
)
def test_clean_names(spark, text, name):
    assert one(spark, names.clean_name(F.col("t")), t=text) == name


@pytest.mark.parametrize(
    ("url", "name"),
    [("https://p.example/v2/producto-detalle/corsa/YK-1/optica-corsa-2001-2004-derecha?x=1", "OPTICA CORSA 2001-2004 DERECHA"), ("https://p.example/a/bomba_de%20agua", "BOMBA DE AGUA"), ("https://p.example/a/123", None), ("https://p.example/", None), ("/x/filtro-%C3%B1", "FILTRO Ñ"), (None, None)],
)
def test_names_of_addresses(spark, url, name):
    assert one(spark, names.name_from_url(F.col("u")), u=url) == name


def test_every_point_of_a_name(spark):
    """Each rule by itself: a title of one word, and candidates that differ from a plain one by one mark."""
    score = lambda c, base="faro", place=0: one(spark, names.name_score(F.col("c"), F.lit(base), F.lit(place)), c=c)
    assert score("zeta") == 100 + 8 and score("zeta", place=30) == 70 + 8 and score("zeta", place=130) == 8
    assert score("Faro") == 100 + 30
    assert score("Faro azul") == 100 + 140 + 90 + 8 and score("el faro") == 100 + 90 + 8
    assert score(" ".join(f"w{i}" for i in range(20))) == 100 + 12 * 8
    assert score("zeta 2004") == 100 + 16 + 55 and score("zeta derecho") == 100 + 16 + 45 and score("zeta tucson") == 100 + 16 + 35
    assert score("ZETA") == 100 + 8 + 10 and score("marca zeta") == 100 + 16 - 200 and score("zeta", base="") == 100 + 8


def test_the_best_name(spark):
    best = lambda texts, title=None: one(spark, names.best_name(F.col("t"), F.col("b")), t=texts, b=title)
    assert best(["Faro", "Faro Corsa 2004 derecho", "Marca: Faro Corsa 2004 izquierdo", "comprar"], "Faro") == "Faro Corsa 2004 derecho"
    assert best(["Zeta uno", "Zeta dos"], "Zeta") == "Zeta uno" and best(["Inicio", None, ""], "Faro") is None and best([]) is None


def test_entries_of_json(spark):
    body = {"a": 1, "total_rows": "1.204", "list": [{"count": 7, "x": None}, [True, "s"]], "o": {"p": {"cantidad": "n/a", "records": 2.5}}}
    feeds = spark.createDataFrame([("u", json.dumps(body)), ("broken", "{"), ("null", None), ("scalar", "3"), ("deep", json.dumps({"a": {"b": {"c": {"d": []}}}}))], "url string, body string")
    found = json_trees.entries(feeds)
    got = {(r.path, r.key, r.value) for r in found.where("id = 'u'").collect()}
    assert got == {("$.a", "a", "1"), ("$.total_rows", "total_rows", "1.204"), ("$.list", "list", None), ("$.list[0]", None, None), ("$.list[1]", None, None), ("$.list[0].count", "count", "7"), ("$.list[0].x", "x", None), ("$.list[1][0]", None, "true"), ("$.list[1][1]", None, "s"), ("$.o", "o", None), ("$.o.p", "p", None), ("$.o.p.cantidad", "cantidad", "n/a"), ("$.o.p.records", "records", "2.5")}
    assert [r.path for r in found.where("id = 'deep'").orderBy("depth").collect()] == ["$.a", "$.a.b", "$.a.b.c", "$.a.b.c.d"]
    assert found.where("id in ('broken', 'null', 'scalar')").count() == 0
    assert [(r.id, int(r["count"])) for r in json_trees.announced_count(found).collect()] == [("u", 1204)]
    assert {r.key: (r.n, r.ids) for r in json_trees.keys(found).where("key in ('a', 'b')").collect()} == {"a": (2, 2), "b": (1, 1)}
    assert "total_rows" in json_trees.shape(feeds.where("url <> 'scalar'")).first()["shape"]


def test_runs(spark):
    summary = json.dumps({"results": [{"site": "a", "status": "ok"}, {"status": "error"}, {"site": "a", "status": "late"}]})
    runs = spark.createDataFrame([("r1", "2024-01-01", summary), ("r2", "2024-01-02", '{"results": 3}'), ("r3", "2024-01-03", None)], "id string, requested_at string, summary string")
    assert [(r.id, r.results_count) for r in jobs.runs_page(runs, 2).collect()] == [("r3", 0), ("r2", 0)]
    assert [r.results_count for r in jobs.runs_page(runs).where("id = 'r1'").collect()] == [3] and jobs.runs_page(runs, 0).count() == 1
    assert sorted((r.run_id, r.site, r.status) for r in jobs.site_rows(runs).collect()) == [("r1", "a", "late"), ("r1", "unknown", "error")]
    trace = json.dumps({"crawl": {"pages": [1, 2], "discoveryMethod": "sitemap"}, "extract": {"urls": [1], "pages": "x"}, "products": [1, 2, 3], "merged": [1]})
    assert tuple(one(spark, jobs.site_trace(F.col("d")), d=trace)) == ("sitemap", 2, 0, 0, 1, 3, 1) and tuple(one(spark, jobs.site_trace(F.col("d")), d="{}")) == ("unknown", 0, 0, 0, 0, 0, 0)


def test_small_operators(spark):
    stock = conform(spark.createDataFrame([("1", "s", "Bomba", ""), ("2", "s ", "Faro", "kept"), ("3", None, None, None)], "id string, site string, product_name string, search_text string"))
    assert inventory.count_by_site(stock, "s") == 1
    assert {r.id: r.search_text for r in inventory.fill_search_text(stock).collect()} == {"1": "bomba", "2": "kept", "3": ""}
    rule = SiteRule("x", ("x.example",))
    assert rule.limits() == (30, 150) and rule.limits(0, 5) == (0, 5)
    rows = spark.createDataFrame([(["a", "b"], [1])], "x array<string>, y array<int>").select(arrays.rows_of(name=F.col("x"), n=F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", None)]
