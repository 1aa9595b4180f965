"""What the operators of this subpackage share: tables in the shared folder, row ids, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import drop_tables, write_table

__all__ = ["ROW_ID", "RowName", "arrow_map", "batches_of", "drop_tables", "known_rows", "place_in_file", "quoted", "slices", "texts", "unpacked", "with_row_id", "write_table"]

ROW_ID = "__row_id"
#: Rows of an Arrow batch at most: a worker holds a batch as it comes, as Python strings, and as it goes.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Rows that are decoded at once from a Parquet file.
READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row_id``, unique for each row (ids of documents may be null or repeated), in place of any column so named.

    The id is a row's place in its partition of this read; another read may be split
    otherwise. What joins ids to rows again takes ``known_rows`` for both sides.
    """
    return docs.withColumn(ROW_ID, F.monotonically_increasing_id())


def quoted(name: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Names the rows of a table, alike in every read; None where it cannot.
RowName = Callable[[DataFrame], Column | None]


def place_in_file(docs: DataFrame) -> Column | None:
    """Names each row of a table that is read straight from Parquet files by its file and its place there; None for other tables.

    The files' own column counts, also where the table has one of that name.
    """
    try:
        places = docs.metadataColumn("_metadata")
        named = F.struct(F.xxhash64(places["file_path"]).alias("file"), places["row_index"].alias("at"))
        docs.select(named)
    except AnalysisException:
        return None
    return named


def known_rows(docs: DataFrame, row: RowName | None = None) -> DataFrame:
    """(__row_id, input), with the same ids in every read; ``input`` has all columns of ``docs``.

    ``row`` names each row, as ``place_in_file`` does for tables of files. Where there is no such
    name the rows are numbered and stored in a table of the shared folder first.
    """
    whole = F.struct(*(quoted(c) for c in docs.columns)).alias("input")
    name = row(docs) if row else None
    if name is not None:
        return docs.select(name.alias(ROW_ID), whole)
    return write_table(docs.select(F.monotonically_increasing_id().alias(ROW_ID), whole), "rows")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``known_rows`` as they came."""
    return rows.select(*(F.col("input").getField(c).alias(c) for c in columns))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch.

    Rows are texts here, so the session's batches are set to ``BATCH_ROWS`` rows at most.
    """
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_SETTING)) > BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch.rename_columns(names))

    # Names with dots or backticks do not get through mapInArrow.
    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of Arrow and of Parquet's reader of so many rows at most, for what is run inside; the session's settings are as they were afterwards."""
    before = {x: spark.conf.get(x) for x in (BATCH_SETTING, READ_SETTING)}
    for x, most in before.items():
        spark.conf.set(x, str(min(rows, int(most)) if int(most) > 0 else rows))
    try:
        yield
    finally:
        for x, most in before.items():
            spark.conf.set(x, most)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about ``budget`` at most, so that memory does not follow a batch's size."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
