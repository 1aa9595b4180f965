import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from shelfspark.sources import profiles, web


class Shop(BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):  # noqa: N802
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        if self.path == "/busy" and n < 2:
            self.send_error(503)
        elif self.path == "/gone":
            self.send_error(404)
        elif self.path == "/loop":
            self.send_response(302)
            self.send_header("Location", f"/loop?{n}")
            self.end_headers()
        else:
            page = int(self.path.split("page=")[1]) if "page=" in self.path else 0
            body = json.dumps({"products": [{"name": f"p{page}{i}"} for i in range(2 if page < 3 else 1)]}) if page else "<p>ñ</p>"
            data = gzip.compress(body.encode())
            self.send_response(200)
            self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def shop():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_web_pages(spark, shop):
    spark.dataSource.register(web.WebPages)
    urls = [f"{shop}/ok", f"{shop}/busy", f"{shop}/gone", f"{shop}/ok", "http://127.0.0.1:9/x"]
    got = {r.url.rsplit("/", 1)[1]: r for r in spark.read.format("web_pages").option("urls", json.dumps(urls)).option("attempts", "2").load().collect()}
    assert len(got) == 4 and got["ok"].body == "<p>ñ</p>" and got["busy"].status == 200
    assert got["gone"].status == 404 and got["gone"].body is None and got["x"].error
    feed = spark.read.format("web_pages").option("urls", json.dumps([f"{shop}/feed"])).option("page_parameter", "page").option("page_size", "2").load()
    assert profiles.extract("json", feed.selectExpr("url", "body")).count() == 5


def test_a_feed_that_is_cut_says_so(spark, shop):
    spark.dataSource.register(web.WebPages)
    feed = lambda most: spark.read.format("web_pages").option("urls", json.dumps([f"{shop}/feed"])).option("page_parameter", "page").option("page_size", "2").option("max_pages", most).load()
    assert [(r.url.split("/")[-1], r.error) for r in feed("2").collect()] == [("feed?page=1", None), ("feed?page=2", None), ("feed?page=3", "max_pages")]
    assert [r.error for r in feed("3").collect()] == [None, None, None]


def test_runs_ask_for_what_is_pending(spark, shop, tmp_path):
    folder, other = str(tmp_path / "pages"), "http://127.0.0.1:9/x"
    first = spark.createDataFrame([(f"{shop}/a{i}",) for i in range(5)] + [(f"{shop}/a0",), (f"{shop}/gone",), (other,), (None,)], "url string")
    assert web.fetch_pending(first, folder, attempts=1, per_host=3, global_limit=4) == 7
    assert web.completed(spark, folder).count() == 5 and web.completed(spark, folder).first().body == "<p>ñ</p>"
    assert {r.url for r in web.failed(spark, folder).collect()} == {f"{shop}/gone", other}
    more = first.unionAll(spark.createDataFrame([(f"{shop}/b",)], "url string"))
    assert web.fetch_pending(more, folder, attempts=1) == 3
    assert web.completed(spark, folder).count() == 6 and max(n for path, n in Shop.asked.items() if path.startswith("/a")) == 1
    assert web.fetch_all(more, global_limit=3).rdd.getNumPartitions() <= 3


def test_lanes_wait(spark, shop):
    import time

    start = time.monotonic()
    assert web.fetch_all(spark.createDataFrame([(f"{shop}/w{i}",) for i in range(4)], "url string"), 2, 1, delay=0.3).where("error is null").count() == 4
    assert time.monotonic() - start > 0.9


def test_types_of_linked_data(spark):
    from shelfspark.sources import feeds

    body = json.dumps({"@graph": [{"@type": ["Thing", "Product"], "name": "A"}, {"@type": "product", "name": "B"}, {"@type": ["Offer"], "name": "C"}, {"name": "D"}]})
    assert sorted(r.product_name for r in feeds.linked_data_products(spark.createDataFrame([("https://a.example/1", body)], "url string, body string")).collect()) == ["A", "B"]


def test_profiles(spark):
    page = '<ul><li class="product"><a href="/p/1"><h2 class="woocommerce-loop-product__title">Bomba</h2></a><del>$ 9</del><ins>$ 7,50</ins></li></ul>'
    df = spark.createDataFrame([("https://a.example/l", page)], "url string, html string")
    assert [(r.product_name, r.price) for r in profiles.extract("woocommerce", df).collect()] == [("Bomba", "7,50")]
    linked = '<script type="application/ld+json">{"@type":"Product","name":"L","offers":{"price":"3"}}</script>'
    pages = spark.createDataFrame([("https://a.example/1", linked + "<h1>no</h1>"), ("https://a.example/2", "<div><h1>Filtro</h1><span class='price'>$ 5</span></div>")], "url string, html string")
    assert {(r.url, r.product_name, r.price) for r in profiles.extract_pages("generic", pages).collect()} == {("https://a.example/1", "L", "3"), ("https://a.example/2", "Filtro", "5")}
