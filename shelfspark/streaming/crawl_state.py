"""What a crawl has done, kept as state of a stream of its events: a crawl that stops goes on where it ended.

Events are (listing, page, kind, keys, message, at): ``page`` with the keys of the products on
it (null where a product has none), ``failed`` with a message, and ``finished``. Events may
come again, in any order and in any batch; each page, each failure and each key of a page
counts once.

What has counted is the state of ``dropDuplicates``, one entry a page, failure, key, and key of
a page, dealt by all of these, so that a listing of very many pages is no single task. What a
batch counts for the first time is added to a log of sums. A second, small stream keeps when a
listing's events were and came last; one that is silent for longer than allowed, while others go
on, is stalled until it has events again.

``run`` keeps state in a store outside of the heap; sessions that start ``counted`` themselves
set ``STORE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..functions import text
from .progress import drain
from .state_log import COMPACT, read_log, state_log

_STATE = "spark.sql.streaming.stateStore."
#: Counting a store's rows would look up each key once more.
STORE = {f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STATE}rocksdb.trackTotalNumberOfRows": "false"}
EVENTS = "listing string, page int, kind string, keys array<string>, message string, at timestamp"
#: Files of a batch's sums.
PARTS = 16
#: Characters of a failure's message that are kept.
MESSAGE = 160
SUMS = ("pages", "products", "fresh", "duplicates", "errors")
COUNTERS = "listing string, pages bigint, products bigint, fresh bigint, duplicates bigint, errors bigint, failed struct<undated:boolean,at:timestamp,message:string>"
TIMES = "listing string, finished boolean, last_at timestamp, arrived timestamp, silent_ms bigint"
#: What is one and the same thing of a crawl.
IDENTITY = ["listing", "kind", "page", "key", "failed_at"]


def dealt(events: DataFrame) -> DataFrame:
    """(listing, kind, page, key, failed_at, n, extra, without_key, message): a row a page or failure, and for each distinct key of a page one (``pair``) with and one (``key``) without the page."""
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    named = F.filter(keys, lambda k: k.isNotNull())
    failed, paged = F.col("kind") == "failed", F.col("kind") == "page"
    redacted = F.substring(text.redact(F.coalesce("message", F.lit(""))), 1, MESSAGE)
    own = events.where(failed | paged).select(
        F.coalesce("listing", F.lit("")).alias("listing"), "kind", F.col("page").cast("int").alias("page"), F.when(failed, F.col("at")).alias("failed_at"), F.when(failed, redacted).alias("message"),
        F.size(keys).alias("all"), F.size(named).alias("named"), F.when(paged, F.array_distinct(named)).otherwise(F.array().cast("array<string>")).alias("keys"),
    )
    none, zero = F.lit(None), F.lit(0)
    first = F.struct("kind", "page", none.cast("string").alias("key"), "failed_at", F.col("all").alias("n"), (F.col("named") - F.size("keys")).alias("extra"), (F.col("all") - F.col("named")).alias("without_key"), "message")

    def each(kind: str, page: Column) -> Column:
        entry = lambda k: F.struct(F.lit(kind).alias("kind"), page.alias("page"), k.alias("key"), none.cast("timestamp").alias("failed_at"), zero.alias("n"), zero.alias("extra"), zero.alias("without_key"), none.cast("string").alias("message"))
        return F.transform("keys", entry)

    return own.select("listing", F.inline(F.concat(F.array(first), each("pair", F.col("page")), each("key", none.cast("int")))))


def counted(events: DataFrame) -> DataFrame:
    """Of a stream of ``events`` what counts for the first time."""
    return dealt(events).dropDuplicates(IDENTITY)


def sums(rows: DataFrame) -> DataFrame:
    """``COUNTERS`` of each listing, of rows that count."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    page = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "page", F.col(c))), F.lit(0))
    failure = F.struct(F.col("failed_at").isNull().alias("undated"), F.col("failed_at").alias("at"), "message")
    first = F.min(F.when(F.col("kind") == "failed", failure)).alias("failed")
    return rows.groupBy("listing").agg(of("page").alias("pages"), page("n").alias("products"), of("key").alias("fresh"), (page("extra") + of("pair") - of("key")).alias("duplicates"), (page("without_key") + of("failed")).alias("errors"), first)


def _added(rows: DataFrame) -> DataFrame:
    """Batches' sums as one row a listing."""
    return rows.groupBy("listing").agg(*(F.sum(c).alias(c) for c in SUMS), F.min("failed").alias("failed"))


def times(events: DataFrame, silent_ms: int = 0) -> DataFrame:
    """``TIMES`` of each listing that a batch has events of; ``arrived``: when the last batch that had some began."""
    arrived = events.withColumn("arrived", F.current_timestamp()).groupBy(F.coalesce("listing", F.lit("")).alias("listing"))
    found = arrived.agg(F.coalesce(F.bool_or(F.col("kind") == "finished"), F.lit(False)).alias("finished"), F.max("at").alias("last_at"), F.max("arrived").alias("arrived"))
    return found.withColumn("silent_ms", F.lit(silent_ms).cast("bigint"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """(listing, pages, products, fresh, duplicates, errors, failed, finished, last_at, stalled) of a crawl's log."""
    held = read_log(spark, f"{folder}/times", TIMES, ["listing"], [])
    now = held.agg(F.max("arrived").alias("now"))
    silent = F.unix_millis("now") - F.unix_millis("arrived") >= F.col("silent_ms")
    states = held.crossJoin(F.broadcast(now)).select("listing", "finished", "last_at", ((F.col("silent_ms") > 0) & silent & ~F.col("finished")).alias("stalled"))
    found = read_log(spark, folder, COUNTERS, ["listing"], [], _added)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in SUMS]
    return states.join(found, "listing", "left").select("listing", *zero, F.col("failed.message").alias("failed"), "finished", "last_at", "stalled")


def run(events: DataFrame, folder: str, silent_ms: int = 0, parts: int = PARTS, compact: int = COMPACT) -> StreamingQuery:
    """Takes all events that are there into the state in ``folder`` and stops; the next run goes on with what has come since. ``silent_ms``: how long a listing may be silent (0: for ever)."""
    conf = events.sparkSession.conf
    before = {name: conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        conf.set(name, value)
    try:
        add, keep = state_log(f"{folder}/log", ["listing"], [], compact, _added), state_log(f"{folder}/log/times", ["listing"], [], compact)
        query = drain(counted(events), f"{folder}/checkpoint", lambda batch, number: add(sums(batch).coalesce(parts), number))
        drain(times(events, silent_ms), f"{folder}/times", keep, "update")
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return query


class Heartbeats(StreamingQueryListener):
    """Calls ``beat(name, time, rows)`` whenever a query of a name makes progress or waits, and ``ended(name, error)`` when it is over."""

    def __init__(self, beat: Callable[[str, str, int], None], ended: Callable[[str, str | None], None] | None = None) -> None:
        self.beat, self.ended, self.names = beat, ended, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.beat(self.names[str(event.id)], event.timestamp, 0)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.beat(p.name or self.names.get(str(p.id), str(p.id)), p.timestamp, p.numInputRows)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self.beat(self.names.get(str(event.id), str(event.id)), event.timestamp, 0)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        if self.ended:
            self.ended(self.names.pop(str(event.id), str(event.id)), event.exception)
