"""Line dedup by winnowing, with DataFrame functions only.

A document is the sequence of its lines that hold more than spaces and tabs, compared
without those at their ends. Each ``GRAM`` lines in a row have a digest. Of every ``WINDOW``
lines in a row, the rightmost smallest digest inside is selected, so two places that share so
many lines select the same digest there: it is their fingerprint. A long line (``LONG`` words)
is a fingerprint of its own, and so are ``GRAM`` lines that have so many words only together.
Selected places alone leave a document; all others are dropped before the first shuffle.

Places are joined on their fingerprint to the first one that has it. From there the match is
extended both ways, line by line, for as long as both places go on alike and by ``WINDOW``
lines at most, as there the next fingerprint begins. The later run is deleted. So

- of a run of ``WINDOW`` lines or more that an earlier place has too, at least all but
  ``WINDOW - GRAM`` lines at each end are deleted, and those as well unless the first place of
  the fingerprint next to them goes on otherwise; a repeated long line is always deleted;
- each line that is deleted stands at an earlier place too, so of every line one copy stays.

Earlier means by doc_id, then by row, then by line; in one document a fingerprint's two places
may not overlap. First places are aggregated before they are shuffled, and each place meets
the first one only: a passage that a third of all documents share costs one row a place.

Defined results: a null text stays null; documents of fewer lines than ``GRAM`` have long lines
alone; rows of null doc_id come after all others; repeated rows are later copies of each other;
of equal digests in a window the last is selected; very long texts are read whole, and their
cost follows their lines; an empty table gives no rows; other columns, one named like the row
id too, are ignored by ``matches`` and kept by ``delete_repeats``. A document can lose all
lines; its text is then empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import ROW_ID, RowName, drop_tables, known_rows, write_table

#: Lines of a window (a repeated run of so many shares a fingerprint), lines of a digest, words of a long line.
WINDOW, GRAM, LONG = 3, 2, 50
#: What ``regexp_count`` takes for a word.
WORD = r"[^\x20\x09-\x0D]+"


def _sequence(text: Column) -> Column:
    """(at, line) of each line that holds something."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("line"))), lambda s: s["line"] != "")


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def places(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long: int = LONG) -> DataFrame:
    """The selected places of each row of ``docs`` (__row_id, doc_id, text): fingerprint, where it is, and the lines around it (hashes, nearest first)."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("doc")
    rows = docs.select(ROW_ID, doc, _sequence(F.col("text")).alias("seq")).where(F.size("seq") > 0)
    words = F.transform("seq", lambda s: F.regexp_count(s["line"], F.lit(WORD)))
    rows = rows.select(ROW_ID, "doc", "seq", F.transform("seq", lambda s: F.xxhash64(s["line"])).alias("hashes"), words.alias("words"))
    joined = lambda j: F.array_join(F.transform(F.slice("seq", j + 1, gram), lambda s: s["line"]), "\n")
    rows = rows.withColumn("digests", F.transform(_upto(F.size("seq") - (gram - 1)), lambda j: F.md5(joined(j).cast("binary"))))
    # A window has window - gram + 1 digests; a document of fewer lines is one window. Of equal digests the last: the least of (digest, -place).
    n, inside = F.size("digests"), window - gram + 1
    starts = F.when(n > 0, _upto(F.greatest(n - (inside - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    least = lambda i: -F.array_min(F.transform(F.slice("digests", i + 1, inside), lambda d, k: F.struct(d.alias("digest"), (-k - i).alias("place"))))["place"]
    its_words = lambda j: F.slice("words", j + 1, gram)
    together = F.filter(_upto(n), lambda j: (F.aggregate(its_words(j), F.lit(0), lambda a, x: a + x) >= long) & (F.lit(gram == 1) | (F.array_max(its_words(j)) < long)))
    chosen = F.array_distinct(F.concat(F.transform(starts, least), together))
    around = lambda j, size: (
        F.reverse(F.slice("hashes", F.greatest(j - window, F.lit(0)) + 1, F.least(j, F.lit(window)))).alias("before"),
        F.slice("hashes", j + (size + 1), window).alias("after"),
        F.transform(F.slice("seq", F.greatest(j - window, F.lit(0)) + 1, F.least(j, F.lit(window)) + (size + window)), lambda s: s["at"]).alias("lines"),
    )
    place = lambda j, size, digest: F.struct(digest.alias("fingerprint"), j.alias("line"), F.lit(size).alias("n_lines"), *around(j, size))
    runs = F.transform(chosen, lambda j: place(j, gram, F.unhex(F.get("digests", j))))
    longs = F.filter(_upto(F.size("seq")), lambda j: F.get("words", j) >= long)
    alone = F.transform(longs, lambda j: place(j, 1, F.unhex(F.md5(F.get("seq", j)["line"].cast("binary")))))
    return rows.select(ROW_ID, "doc", F.inline(F.concat(runs, alone) if gram > 1 else runs))


def _alike(a: Column, b: Column) -> Column:
    """How many first items of two short lists are equal in turn."""
    both = _upto(F.least(F.size(a), F.size(b)))
    return F.aggregate(both, F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))


def matches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long: int = LONG) -> DataFrame:
    """Each run of lines that an earlier place has too: (__row_id, from_line, to_line) in lines of the text, around one fingerprint."""
    found = write_table(places(docs, window, gram, long), "line-places")
    # Tables of their own: their sizes are known when joins are planned, and a join with a very common fingerprint can be split.
    shared = write_table(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "line-fingerprints")
    several = write_table(found.join(shared, "fingerprint", "left_semi"), "line-places")
    drop_tables(found, shared)
    place = F.struct("doc", F.col(ROW_ID).alias("row"), "line", "before", "after")
    first = write_table(several.groupBy("fingerprint").agg(F.min(place).alias("first")), "line-firsts")
    joined = several.join(first, "fingerprint")
    other = F.col("first.row") != F.col(ROW_ID)
    later = joined.where(other | (F.col("first.line") + F.col("n_lines") <= F.col("line")))
    known = F.size("before")
    begin, end = known - _alike(F.col("before"), F.col("first.before")), known + F.col("n_lines") + _alike(F.col("after"), F.col("first.after"))
    return later.select(ROW_ID, F.get("lines", begin).alias("from_line"), (F.get("lines", end - 1) + 1).alias("to_line"))


def runs(found: DataFrame) -> DataFrame:
    """Per row: its maximal runs of lines to delete, from touching or overlapping matches."""
    order = Window.partitionBy(ROW_ID).orderBy("from_line")
    reach = F.max("to_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = found.withColumn("new", (F.col("from_line") > F.coalesce(reach, F.lit(-1))).cast("int"))
    numbered = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy(ROW_ID, "run").agg(F.min("from_line").alias("from_line"), F.max("to_line").alias("to_line"))
    return each.groupBy(ROW_ID).agg(F.array_sort(F.collect_list(F.struct("from_line", "to_line"))).alias("runs"))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long: int = LONG, row: RowName | None = None) -> DataFrame:
    """``docs`` as ``input``, with ``runs`` (null if none), and the ``kept`` text; ``row`` as in ``known_rows``."""
    rows = known_rows(docs, row)
    # A table of its own, so that its size is known when the join with all texts is planned.
    gone = write_table(runs(matches(rows.select(ROW_ID, "input.doc_id", "input.text"), window, gram, long)), "line-runs")
    joined = rows.join(gone, ROW_ID, "left")
    lines = F.split("input.text", "\n")
    # What lies before, between and after the runs.
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["to_line"])
    end = lambda i: F.coalesce(F.get("runs", i)["from_line"], F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))
    return joined.withColumn("kept", F.when(F.col("runs").isNull(), F.col("input.text")).otherwise(F.array_join(kept, "\n")))


def delete_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long: int = LONG, row: RowName | None = None) -> DataFrame:
    """``docs`` without the lines that an earlier place repeats."""
    done = deduplicate(docs, window, gram, long, row)
    return done.select(*(F.col("kept").alias("text") if c == "text" else F.col("input")[c].alias(c) for c in docs.columns))
