"""Pages and feeds over HTTP as a Python data source: one partition per host, requests of a host one after another.

    spark.dataSource.register(WebPages)
    spark.read.format("web_pages").option("urls", json.dumps([...])).load()

Options: ``urls`` (a JSON list), ``timeout`` in seconds, ``attempts``, ``delay`` between the
requests of a host in seconds, ``page_parameter`` and ``max_pages`` to follow a feed page by
page, and ``page_size``: a page of fewer items ends its feed. A feed that ``max_pages`` cuts
has a last row with the error ``max_pages`` and the address that it would have asked next.
A page that cannot be had is a row with an error; it fails no task.

``fetch_pending`` reads a table of addresses instead, in runs that go on where others ended.
"""

from __future__ import annotations

import gzip
import json
import time
import zlib
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, headers map<string,string>, body string, error string"
RETRIED = (429, 500, 502, 503, 504)
MOST_REDIRECTS = 5


class _FewRedirects(HTTPRedirectHandler):
    max_redirections = MOST_REDIRECTS


def _decoded(data: bytes, encoding: str) -> bytes:
    if encoding == "gzip":
        return gzip.decompress(data)
    if encoding == "deflate":
        try:
            return zlib.decompress(data)
        except zlib.error:
            return zlib.decompress(data, -zlib.MAX_WBITS)
    return data


def fetch(url: str, timeout: float = 45.0, attempts: int = 3, wait: float = 0.5) -> tuple:
    """A row of the source; busy and failing servers are asked again after growing pauses."""
    error, status = "", None
    for attempt in range(attempts):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            request = Request(url, headers={"Accept-Encoding": "gzip, deflate", "User-Agent": "catalog-reader"})
            with build_opener(_FewRedirects).open(request, timeout=timeout) as answer:
                headers = {k.lower(): v for k, v in answer.headers.items()}
                body = _decoded(answer.read(), headers.get("content-encoding", ""))
                charset = answer.headers.get_content_charset() or "utf-8"
                return url, answer.geturl(), answer.status, headers, body.decode(charset, "replace"), None
        except HTTPError as e:
            error, status = f"HTTP {e.code}", e.code
            if e.code not in RETRIED:
                break
        except (OSError, ValueError, EOFError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
    return url, None, status, {}, None, error


def _items(body: str | None) -> int:
    """How many items a JSON page has: its longest list."""
    try:
        value = json.loads(body or "")
    except ValueError:
        return 0
    lists = [value] if isinstance(value, list) else [v for v in value.values() if isinstance(v, list)] if isinstance(value, dict) else []
    return max(map(len, lists), default=0)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(None)
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[HostPartition]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(json.loads(self.options.get("urls", "[]"))):
            hosts.setdefault(urlsplit(url).netloc.lower(), []).append(url)
        return [HostPartition(x) for x in hosts.values()]

    def _pages(self, url: str) -> Iterator[str]:
        name = self.options.get("page_parameter")
        if not name:
            yield url
            return
        for n in range(1, int(self.options.get("max_pages", "100")) + 1):
            yield f"{url}{'&' if '?' in url else '?'}{urlencode({name: n})}"

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        get = self.options.get
        size = int(get("page_size", "0"))
        for url in partition.urls:
            for page in self._pages(url):
                row = fetch(page, float(get("timeout", "45")), int(get("attempts", "3")))
                yield row
                if row[5] or (get("page_parameter") and _items(row[4]) < max(size, 1)):
                    break
                time.sleep(float(get("delay", "0")))
            else:
                if name := get("page_parameter"):
                    following = int(get("max_pages", "100")) + 1
                    yield f"{url}{'&' if '?' in url else '?'}{urlencode({name: following})}", None, None, {}, None, "max_pages"


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WebReader:
        return WebReader(self.options)


def fetch_all(addresses: DataFrame, global_limit: int = 8, per_host: int = 2, delay: float = 0.0, attempts: int = 3, timeout: float = 45.0) -> DataFrame:
    """The pages of ``addresses`` (url), each once: at most ``global_limit`` requests at a time, and ``per_host`` of a host.

    A host's addresses are dealt to ``per_host`` lanes by hash, and lanes to ``global_limit``
    partitions, which ask one address after the other; the least time between two requests of a
    lane is ``delay`` seconds. A large host is no single task unless ``per_host`` is one.
    """
    lanes, width = max(1, min(per_host, 20)), max(1, min(global_limit, 100))
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1))
    lane = F.struct(host, F.pmod(F.xxhash64("url"), F.lit(lanes)).alias("lane"))
    dealt = addresses.select("url").where("url is not null").distinct().withColumn("lane", F.xxhash64(lane))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, float] = {}
        for batch in batches:
            for url, lane in zip(batch.column("url").to_pylist(), batch.column("lane").to_pylist(), strict=True):
                if delay and lane in last:
                    time.sleep(max(0.0, last[lane] + delay - time.monotonic()))
                last[lane] = time.monotonic()
                row = fetch(url, timeout, max(1, min(attempts, 11)))
                columns = [[x] for x in (*row[:3], list(row[3].items()), *row[4:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=["url", "final_url", "status", "headers", "body", "error"])

    return dealt.repartition(width, "lane").mapInArrow(run, SCHEMA)


_KINDS = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that runs into ``folder`` have had."""
    return _rows(spark, folder).where("error is null")


def failed(spark: SparkSession, folder: str) -> DataFrame:
    """(url, error) of addresses that no run has had, with the message of one that tried."""
    return _rows(spark, folder).where("error is not null").join(completed(spark, folder).select("url"), "url", "left_anti").groupBy("url").agg(F.max("error").alias("error"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(folder) if there else spark.createDataFrame([], SCHEMA)


def fetch_pending(addresses: DataFrame, folder: str, **options: float) -> int:
    """Adds to ``folder`` the pages of ``addresses`` that no run has had yet (those that failed are asked again); how many were asked."""
    done = completed(addresses.sparkSession, folder).select("url")
    pending = addresses.select("url").where("url is not null").distinct().join(done, "url", "left_anti")
    n = pending.count()
    if n:
        fetch_all(pending, **options).write.mode("append").parquet(folder)
    return n
