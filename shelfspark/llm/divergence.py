"""Source divergence audit by joint count histograms.

For each pair of sources of a language the kept terms are tallied by their two counts,
(count here, count there); terms that one of the two lacks give cells with a zero, and
terms that both lack are what the other cells leave of the vocabulary. The divergence is
evaluated once for each cell and taken as often as the cell has terms.

Tallies are made per block of terms: the counts of a block are a matrix of terms by sources
in one task, whose size is bounded (a language's sources times the block's terms), and only
cells leave the task, so that no term is joined with itself over sources.

Defined results: null text, lang and source count as ''. A source whose documents have no
kept term has count zero everywhere. A language without kept terms gives its pairs the value
0 and no terms. Repeated rows count each. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import write_table

#: A term is kept if so many documents of its language have it.
LEAST_DOCUMENTS = 10
#: Probabilities are integers, of this scale; a count has this added to it.
SCALE, ADDED = 1_000_000_000, 2
#: Terms that are reported of a group.
TOP_TERMS = 10
#: Entries that a task holds before it gives them on.
HELD = 400_000
#: Cells of a matrix of terms by sources.
MATRIX = 1 << 22
#: Bytes as UTF-8 has them: letters in lower case and all of other characters stay, the rest parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms by language and source; a row without term for each of these that occurs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(docs[x] for x in n)]]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            own = Counter(text.translate(TERM_BYTES).split())
            n.update(own)
            docs.update(own.keys())
            held += len(n)
            if held > HELD:
                yield from given()
                held = 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; one row of null term a group."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    return read.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (n + ADDED * v)), exact also beyond 64 bits."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED), wide(n + ADDED * v))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two probabilities."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tallies(counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of sources (columns of ``counts``): cells that are not (0, 0), and how many terms each has."""
    for i in range(counts.shape[1]):
        for j in range(i + 1, counts.shape[1]):
            a, b = counts[:, i], counts[:, j]
            some = (a > 0) | (b > 0)
            a, b = a[some], b[some]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))[: len(a)])
            yield i, j, a[first], b[first], np.diff(np.append(first, len(a)))


CELLS = "lang string, one string, other string, here bigint, there bigint, terms bigint"


def _cells(lang: str, sources: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = pa.array(sources, pa.string())
    found: list[tuple] = []
    held = 0

    def given() -> pa.RecordBatch:
        i, j, sizes = (np.array(x) for x in zip(*((i, j, len(n)) for i, j, _, _, n in found), strict=True))
        here, there, n = (np.concatenate([x[k] for x in found]) for k in (2, 3, 4))
        one, other = (names.take(pa.array(np.repeat(x, sizes))) for x in (i, j))
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), one, other, pa.array(here), pa.array(there), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CELLS.split(", ")])

    for tally in _tallies(counts):
        found.append(tally)
        held += len(tally[4])
        if held > HELD:
            yield given()
            found.clear()
            held = 0
    if found:
        yield given()


def _block_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        sizes = batch.column("counts").value_lengths().to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        flat = batch.column("counts").flatten()
        names, counts = flat.field("source").to_pylist(), flat.field("n").to_numpy()
        for lang in sorted(set(langs.tolist())):
            rows = np.flatnonzero(langs == lang)
            at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
            sources = sorted({names[i] for i in at})
            code = {x: i for i, x in enumerate(sources)}
            step = max(1, MATRIX // len(sources))
            of, place = np.array([code[names[i]] for i in at]), np.repeat(np.arange(len(rows)), sizes[rows])
            for start in range(0, len(rows), step):
                own = (place >= start) & (place < start + step)
                matrix = np.zeros((min(step, len(rows) - start), len(sources)), np.int64)
                matrix[place[own] - start, of[own]] = counts[at[own]]
                yield from _cells(lang, sources, matrix)


def joint_histograms(kept: DataFrame) -> DataFrame:
    """(lang, one, other, here, there, terms) of ``kept`` (lang, source, term, n) for one < other, without the cells (0, 0).

    A source that a block of terms lacks gives no cell there; ``_with_zeros`` adds what is left.
    """
    listed = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"))
    return listed.select("lang", "counts").mapInArrow(_block_cells, CELLS)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Part ``pair``: the divergence of a source from each other one of its language. Part
    ``term``: the terms that a source has more often than its language, the first of them.
    """
    counts = write_table(term_counts(docs), "term-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    whole = write_table(terms.where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "total"), "kept-terms")
    kept = write_table(counts.where("term is not null").select("lang", "source", "term", "n").join(whole, ["lang", "term"]), "kept-counts")

    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    occurring = counts.where("term is null").select("lang", "source")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = write_table(
        occurring.join(sums, ["lang", "source"], "left").join(langs, ["lang"], "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n")),
        "groups",
    )
    return _pairs(kept, groups).unionByName(_terms(kept, groups))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    one = groups.select("lang", F.col("source").alias("one"), F.col("n").alias("one_n"), "v")
    other = groups.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n"))
    pairs = one.join(other, "lang").where("one < other")  # as many as the result has
    cells = write_table(joint_histograms(kept.select("lang", "source", "term", "n")).groupBy("lang", "one", "other", "here", "there").agg(F.sum("terms").alias("terms")), "cells")
    # Blocks without one of the sources have not tallied it: terms that the other one has there are cells with a zero.
    every = _with_zeros(cells, kept, pairs)
    value = divergence(probability(F.col("here"), F.col("one_n"), F.col("v")), probability(F.col("there"), F.col("other_n"), F.col("v"))) * F.col("terms")
    found = every.join(pairs, ["lang", "one", "other"]).groupBy("lang", "one", "other").agg(F.sum(F.when(F.col("terms") > 0, value).otherwise(0)).alias("value"))
    sides = F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))
    both = found.select("lang", F.explode(sides).alias("side"), "value").select("lang", "side.*", "value")
    return _ranked(both, "pair")


def _with_zeros(cells: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cells`` and what they lack of each source's terms, as cells with a zero; then the terms that neither source has."""
    margins = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("all_terms"))

    def lacking(side: str, count: str, zero: str) -> DataFrame:
        own = pairs.select("lang", "one", "other").join(margins.select("lang", F.col("source").alias(side), F.col("n").alias(count), "all_terms"), ["lang", side])
        seen = cells.where(F.col(count) > 0).groupBy("lang", "one", "other", count).agg(F.sum("terms").alias("seen"))
        left = own.join(seen, ["lang", "one", "other", count], "left").select("lang", "one", "other", F.col(count), F.lit(0).cast("bigint").alias(zero), (F.col("all_terms") - F.coalesce("seen", F.lit(0))).alias("terms"))
        return left.where("terms > 0")

    some = cells.unionByName(lacking("one", "here", "there")).unionByName(lacking("other", "there", "here"))
    told = some.groupBy("lang", "one", "other").agg(F.sum("terms").alias("told"))
    none = pairs.join(told, ["lang", "one", "other"], "left").select("lang", "one", "other", F.lit(0).cast("bigint").alias("here"), F.lit(0).cast("bigint").alias("there"), (F.col("v") - F.coalesce("told", F.lit(0))).alias("terms"))
    return some.unionByName(none)


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    joined = kept.withColumnRenamed("n", "count").join(groups, ["lang", "source"])
    p, q = probability(F.col("count"), F.col("n"), F.col("v")), probability(F.col("total"), F.col("lang_n"), F.col("v"))
    judged = joined.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(judged.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= TOP_TERMS)


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return found.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.row_number().over(order).alias("rank"))
