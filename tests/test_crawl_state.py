"""A crawl's state from events in any order, again and again, in runs that stop in between."""

import datetime
import random

import pytest

from shelfspark.streaming import crawl_state, state_log

T0 = datetime.datetime(2024, 1, 1)
COLUMNS = ["listing", "pages", "products", "fresh", "duplicates", "errors", "failed", "finished"]


def plain(events):
    """Each page, failure and key of a page once."""
    out = {}
    for name in {e[0] for e in events}:
        own = [e for e in events if e[0] == name]
        pages = {e[1]: e[3] for e in own if e[2] == "page"}
        failures = {(e[5], e[1]): e[4] for e in own if e[2] == "failed"}
        named = [k for keys in pages.values() for k in keys if k is not None]
        products = sum(map(len, pages.values()))
        first = min(((at, m) for (at, _), m in failures.items()), default=(None, None))[1]
        out[name] = (len(pages), products, len(set(named)), len(named) - len(set(named)), products - len(named) + len(failures), first, any(e[2] == "finished" for e in own))
    return out


def invented(seed):
    of = random.Random(seed)
    events = []
    for name, n in (("hot", 60), ("b", 7), ("c", 1)):
        for page in range(n):
            at = T0 + datetime.timedelta(seconds=len(events))
            events.append((name, page, "page", [None if of.random() < 0.1 else f"k{of.randrange(40)}" for _ in range(of.randrange(5))], None, at))
            if of.random() < 0.2:
                events.append((name, page, "failed", None, f"HTTP {of.randrange(500, 504)} at token=secret{page}", at))
    events.append(("b", None, "finished", None, None, T0))
    again = of.sample(events, 25)
    events += again
    of.shuffle(events)
    return events


def rows(spark, folder):
    return {r[0]: tuple(r)[1:] for r in crawl_state.listings(spark, f"{folder}/log").select(*COLUMNS).collect()}


@pytest.mark.parametrize("compact", [2, 100])
def test_a_crawl_that_stops_and_goes_on(spark, tmp_path, compact):
    events = invented(3)
    source, folder = str(tmp_path / "events"), str(tmp_path / "state")
    read = lambda: spark.readStream.schema(crawl_state.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    done = []
    for start in range(0, len(events), 25):
        some = events[start : start + 25]
        spark.createDataFrame(some, crawl_state.EVENTS).coalesce(1).write.mode("append").parquet(source)
        done += some
        if start in (50, 75):
            crawl_state.run(read(), folder, compact=compact)
            want = plain([(*e[:4], e[4] and e[4].partition("=")[0] + "=[REDACTED]", e[5]) for e in done])
            assert rows(spark, folder) == want
    crawl_state.run(read(), folder, compact=compact)
    want = plain([(*e[:4], e[4] and e[4].partition("=")[0] + "=[REDACTED]", e[5]) for e in events])
    assert rows(spark, folder) == want
    kinds = [x[0] for x in state_log._parts(spark, f"{folder}/log")]
    assert ("base" in kinds) == (compact == 2) and (compact != 2 or len(kinds) <= 4)


def test_silent_listings_stall_until_they_go_on(spark, tmp_path):
    source, folder = str(tmp_path / "events"), str(tmp_path / "state")
    add = lambda *events: spark.createDataFrame(list(events), crawl_state.EVENTS).coalesce(1).write.mode("append").parquet(source)
    run = lambda: crawl_state.run(spark.readStream.schema(crawl_state.EVENTS).parquet(source), folder, silent_ms=1, parts=1)
    stalled = lambda: {r.listing: r.stalled for r in crawl_state.listings(spark, f"{folder}/log").collect()}
    add(("a", 1, "page", ["x"], None, T0), ("b", 1, "page", ["y"], None, T0), ("b", None, "finished", None, None, T0))
    run()
    add(("c", 1, "page", ["z"], None, T0))
    run()
    assert stalled() == {"a": True, "b": False, "c": False}
    add(("a", 2, "page", ["x"], None, T0))
    run()
    assert stalled() == {"a": False, "b": False, "c": True}


def test_heartbeats(spark, tmp_path):
    beats, ends = [], []
    listener = crawl_state.Heartbeats(lambda name, at, n: beats.append((name, n)), lambda name, error: ends.append((name, error)))
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        source.writeStream.queryName("job-7").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert ("job-7", 0) in beats and sum(n for name, n in beats if name == "job-7") == 10 and ends == [("job-7", None)]


def test_messages_are_cut_and_hold_no_secrets(spark):
    events = spark.createDataFrame([(None, None, "failed", None, "password=abc " + "x" * 400, None)], crawl_state.EVENTS)
    row = crawl_state.dealt(events).first()
    assert row.listing == "" and len(row.message) == crawl_state.MESSAGE and "abc" not in row.message


def test_counting_stays_out_of_python(spark, tmp_path):
    """State is Spark's own, dealt by what counts: no row is given to Python, and no listing is a task."""
    spark.createDataFrame([], crawl_state.EVENTS).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(crawl_state.EVENTS).parquet(str(tmp_path / "events"))
    plan = crawl_state.counted(stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan and "InPandas" not in plan


def test_times_of_events_that_come_again(spark, tmp_path):
    """A page that comes again later counts once, but the listing was seen later."""
    source, folder = str(tmp_path / "events"), str(tmp_path / "state")
    later = T0 + datetime.timedelta(hours=1)
    for at, keys in ((T0, ["x"]), (later, ["x", "y"])):
        spark.createDataFrame([("a", 1, "page", keys, None, at)], crawl_state.EVENTS).coalesce(1).write.mode("append").parquet(source)
        crawl_state.run(spark.readStream.schema(crawl_state.EVENTS).parquet(source), folder)
    row = crawl_state.listings(spark, f"{folder}/log").first()
    assert (row.pages, row.products, row.fresh, row.duplicates, row.errors, row.last_at, row.stalled) == (1, 1, 2, 0, 0, later, False)
