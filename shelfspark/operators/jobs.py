"""Runs and jobs as append-only events, with latest states and roll-ups as views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest event of each key. Aggregates before the shuffle, so a busy key is no single task."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def roll_up(progress: DataFrame, job: str, status: str = "status", quantity: str = "quantity") -> DataFrame:
    """Per job: sites done and active, and all products so far."""
    return progress.groupBy(job).agg(
        F.count("*").alias("total_sites"), F.count_if(F.col(status).isin("success", "error")).alias("completed_sites"), F.count_if(F.col(status) == "processing").alias("active_sites"), F.coalesce(F.sum(quantity), F.lit(0)).alias("total_products")
    )


def site_list(progress: DataFrame, job: str, site: str, value: list[str]) -> DataFrame:
    """Per job its sites' states in order of site; a job has as many as sites were asked for."""
    return progress.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(site, *value))).alias("sites"))


def last_site_with(progress: DataFrame, job: str, site: str, product: str) -> DataFrame:
    """Per job the last site, by name, that has a product, and that product."""
    return progress.where(F.col(product).isNotNull()).groupBy(job).agg(F.max(site).alias("current_site"), F.max_by(product, site).alias("last_product"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def runs_page(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest runs, 20 if not said otherwise, 100 at most, with ``results_count`` where they have a ``summary``."""
    rows = runs.orderBy(F.desc("requested_at"), "id").limit(max(1, min(20 if limit is None else limit, 100)))
    return rows.withColumn("results_count", array_length(F.col("summary"), "results")) if "summary" in runs.columns else rows


def array_length(document: Column, name: str) -> Column:
    """The length of a list in a JSON text; 0 if it is no list."""
    return F.coalesce(F.json_array_length(F.get_json_object(document, f"$.{name}")), F.lit(0))


def site_trace(document: Column) -> Column:
    """What a run's document (crawl, extract, products, merged) says of a site, as counts."""
    part = lambda name: F.get_json_object(document, f"$.{name}")
    return F.struct(
        F.coalesce(F.get_json_object(document, "$.crawl.discoveryMethod"), F.lit("unknown")).alias("discovery_method"), array_length(part("crawl"), "pages").alias("pages_discovered"), array_length(part("crawl"), "discoveredUrls").alias("urls_discovered"),
        array_length(part("extract"), "pages").alias("pages_processed"), array_length(part("extract"), "urls").alias("urls_requested"), array_length(document, "products").alias("raw_products"), array_length(document, "merged").alias("merged_products"),
    )


def site_rows(runs: DataFrame) -> DataFrame:
    """(run_id, site, status, payload) of runs' summaries (id, summary: JSON with results); of a site that a run has twice the last counts."""
    each = F.from_json(F.get_json_object("summary", "$.results"), "array<string>")
    rows = runs.select(F.col("id").alias("run_id"), F.posexplode(each).alias("place", "payload"))
    text = lambda name: F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit("unknown"))
    named = rows.select("run_id", "place", text("site").alias("site"), text("status").alias("status"), "payload")
    return named.groupBy("run_id", "site").agg(F.max_by(F.struct("status", "payload"), "place").alias("r")).select("run_id", "site", "r.*")


def run_sites(sites: DataFrame, run_id: str) -> DataFrame:
    return sites.where(F.col("run_id") == run_id).orderBy("site")


def merge_run_sites(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Run rows by (run_id, site), the fresh ones instead of stored ones."""
    return stored.join(fresh.select("run_id", "site"), ["run_id", "site"], "left_anti").unionByName(fresh)


def transitions(events: DataFrame) -> DataFrame:
    """Events that may follow their job's state: queued to processing, processing to completed or failed."""
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    before = F.lag("status").over(order)
    ok = (before.isNull() & (F.col("status") == "queued")) | ((before == "queued") & (F.col("status") == "processing")) | ((before == "processing") & F.col("status").isin("completed", "failed", "processing"))
    return events.withColumn("valid", F.coalesce(ok, F.lit(False)))
