"""Secret scans: patterns for credentials, judged by who owns each value over the whole corpus.

A value found in many repositories of many owners is a copied example; one that only few
owners hold looks live. Candidates are hashed where they are found, so no value leaves its
task in plain text, and the hashes are aggregated by distinct repositories and owners.

Defined results: a null text counts as empty; an empty text has no spans; null repositories and
owners count as one unnamed repository or owner; repeated rows give repeated results and do not
raise a value's number of owners; very long texts are searched whole; spans of one start come
by kind; an empty table gives no rows; other columns, whatever their names, are ignored by
``scan`` and kept by ``redact``. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .support import ROW_ID, arrow_map, quoted, write_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs long enough to be a key, before the tests of ``looks_random``.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "opaque")
#: A value of more owners, or of more repositories, than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4


def looks_random(value: str, bits: float = 3.5) -> bool:
    """Upper and lower case and digits, and at least so many bits of entropy a character."""
    if not (re.search("[A-Z]", value) and re.search("[a-z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= bits


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that no fixed pattern touches; ``base`` is sorted."""
    starts = [s for s, _, _, _ in base]
    # Base spans may overlap, so the furthest end up to each one tells whether any reaches a run.
    reach = [0, *accumulate((e for _, _, e, _ in base), max)]
    return [(m.start(), 3, m.end(), m[0]) for m in OPAQUE.finditer(text) if reach[bisect_left(starts, m.end())] <= m.start() and looks_random(m[0])]


SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"


def _candidates(docs: DataFrame, repository: Column, owner: Column, whole: bool = False) -> DataFrame:
    """Per row: a new id, the spans with hashed values, and if ``whole`` all columns of ``docs`` as ``input``; in a table of the shared folder."""
    given = F.struct(*map(quoted, docs.columns) if whole else ["text"]).alias("input")
    wanted = docs.select(F.monotonically_increasing_id().alias(ROW_ID), F.col("doc_id").cast("bigint").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), given)
    kept = wanted if whole else wanted.drop("input")
    names, kind = kept.columns, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in batch.column("input").field("text").to_pylist():
            base = base_spans(text or "")
            spans = sorted(base + opaque_spans(text or "", base))
            rows.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for s, k, e, v in spans])
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(rows, kind)], names=[*names, "found"])

    found = StructField("found", wanted.select(F.from_json(F.lit("[]"), f"array<{SPAN}>").alias("found")).schema["found"].dataType)
    return write_table(arrow_map(wanted, run, StructType([*kept.schema.fields, found])), "secret-candidates")


def ownership(spans: DataFrame) -> DataFrame:
    """Per hash: distinct owners and repositories, and whether it is a copied example.

    Repeats within a repository go first, before the shuffle; the counts then are over
    distinct triples, so that a value in a third of all rows costs one row a repository.
    """
    held = spans.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    return owners.withColumn("example", (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES))


def _judged(rows: DataFrame) -> DataFrame:
    """(__row_id, found) of the candidate rows that have spans: these by start, with owners, repositories and ``example``; random-looking runs only if they are owner-specific."""
    spans = rows.where(F.size("found") > 0).select(ROW_ID, "repository", "owner", F.inline("found"))
    judged = spans.join(ownership(spans), "hash")
    kept = judged.where((F.col("kind") < 3) | ~F.col("example"))
    return kept.groupBy(ROW_ID).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repositories", "example"))).alias("found"))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): __row_id, doc_id and ``found``, its spans by start with ``n_owners`` and ``example``; null if none.

    Spans of the fixed patterns always stay; random-looking runs stay if their value is owner-specific.
    """
    rows = _candidates(docs, repository, owner)
    return rows.select(ROW_ID, "doc_id").join(_judged(rows), ROW_ID, "left")


def _listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what ``scan`` returns."""
    found = F.coalesce("found", F.from_json(F.lit("[]"), scanned.schema["found"].dataType))
    rows = scanned.withColumn("found", found)
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        *(of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(_listed(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        of(3).alias("n_opaque"),
        F.size(F.filter("found", lambda x: ~x["example"])).cast("bigint").alias("n_live"),
        F.size(F.filter("found", lambda x: x["example"])).cast("bigint").alias("n_example"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each live-looking span replaced by ``mark``; copied examples and all else stay.

    Only rows that have spans are joined to the verdicts; all others pass as they are.
    """
    rows = _candidates(docs, repository, owner, whole=True)
    live = _judged(rows).select(ROW_ID, F.filter("found", lambda x: ~x["example"]).alias("live")).where(F.size("live") > 0)
    text = F.col("input.text")
    # Spans may overlap (a hex value after "password="): text is copied from the furthest end so far.
    between = lambda acc, x: F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
    step = lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
        F.struct(F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(between(acc, x), F.lit(mark))))).alias("out"), x["end"].alias("at"))
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    whole = F.aggregate("live", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    joined = rows.where(F.size("found") > 0).join(live, ROW_ID, "left").select("input", F.when(F.col("live").isNull(), text).otherwise(whole).alias("text"))
    both = joined.union(rows.where(F.size("found") == 0).select("input", text.alias("text")))
    return both.select(*(F.col("text") if c == "text" else F.col("input")[c].alias(c) for c in docs.columns))
