"""Quality rules by document, and verdicts by host.

Each document's rule failures are counted by host; the hosts' failure rates are shrunk
towards the corpus with an empirical beta prior, so that a host of few documents is not
judged by them alone; and the verdicts are joined back to the documents.

Defined results: a null text has no words and fails; a null host is a host of its own; an
empty text fails; very long texts are measured whole; a repeated line or window counts every
time but the first, or every time; repeated rows count and are judged each; an empty table
gives no rows and a flat prior; other columns, whatever their names, are ignored by ``assess``
and kept by ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, drop_tables, texts, write_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A host is rejected if, this many deviations below, its shrunk failure rate still is over the limit.
HOST_LIMIT, DEVIATIONS = 0.8, 2.0
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 10_000.0)


def measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 5-word windows."""
    words = WORD.findall(text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif WORD.search(line):
            seen.add(line)
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered_to = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(i, covered_to)
                covered_to = i + WINDOW
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup_lines, repeated


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_stats(docs: DataFrame, host: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its id, host, measures and ``base_failed``, in a table of the shared folder."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.cast("string").alias("host"), "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [measures(x) for x in texts(batch)]
        columns = [batch.column(x) for x in ("doc_id", "host")] + [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(STATS))]
        failed = pa.array([fails(x) for x in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([*columns, failed], names=["doc_id", "host", *STATS, "base_failed"])

    stats = arrow_map(wanted, run, "doc_id bigint, host string, " + ", ".join(f"{x} bigint" for x in STATS) + ", base_failed boolean")
    return write_table(stats, "quality-stats")


def fails(measured: tuple[int, int, int, int, int]) -> bool:
    """Whether a document's own rules reject it."""
    words, _, _, _, repeated = measured
    return words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * words


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Of a failure rate, by moments over the hosts: the variance between hosts less what chance makes of it.

    Only one row of sums comes to the driver.
    """
    rate = F.col("failed") / F.col("n")
    x = hosts.agg(F.sum("failed").alias("failed"), F.sum("n").alias("n"), F.var_samp(rate).alias("between"), F.avg(1 / F.col("n")).alias("chance")).first()
    if not x["n"]:
        return 1.0, 1.0
    mean = min(max(x["failed"] / x["n"], 1e-4), 1 - 1e-4)
    spread = mean * (1 - mean)
    between = (x["between"] or 0.0) - spread * x["chance"]
    weight = spread / between - 1 if between > 0 else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return mean * weight, (1 - mean) * weight


def host_verdicts(stats: DataFrame) -> DataFrame:
    """Per host: documents, failures, the shrunk failure rate and whether the host is rejected."""
    hosts = stats.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    a, b = beta_prior(hosts)
    total = F.col("n") + F.lit(a + b)
    mean = (F.col("failed") + F.lit(a)) / total
    return hosts.withColumn("host_rate", mean).withColumn("host_rejected", mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (total + 1)) > HOST_LIMIT)


def assess(docs: DataFrame, host: Column) -> DataFrame:
    """Per row of ``docs``: measures, ``base_failed``, its host's shrunk rate, and ``kept``."""
    stats = document_stats(docs, host)
    # Hosts are few beside documents; the join is left to adaptive execution.
    hosts = host_verdicts(stats).select(F.col("host").alias("of_host"), "host_rate", "host_rejected")
    judged = stats.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("of_host")


def keep(docs: DataFrame, host: Column) -> DataFrame:
    """The rows of ``docs`` that neither their own rules nor their host's verdict reject.

    Texts are measured again where they lie instead of being stored or shuffled for their
    verdicts; only the rejected hosts, if there are any, are joined.
    """
    stats = document_stats(docs, host)
    rejected = write_table(host_verdicts(stats).where("host_rejected").select(F.struct("host").alias("of_host")), "rejected-hosts")
    drop_tables(stats)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([not fails(measures(x)) for x in texts(batch)], pa.bool_()))

    good = arrow_map(docs.where(F.length("text") > 0), run, docs.schema)
    # A struct of a null host is a key like any other.
    return good.join(rejected, F.struct(host.cast("string").alias("host")) == rejected["of_host"], "left_anti")
