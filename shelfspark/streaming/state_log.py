"""Latest states as a log: each batch of a stream adds what it changed, and no batch rewrites the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import latest

Merge = Callable[[DataFrame], DataFrame]
#: Batches of a log after which their latest states are put together.
COMPACT = 20


def state_log(folder: str, keys: list[str], order: list[str], compact: int = COMPACT, merge: Merge | None = None) -> Callable[[DataFrame, int], None]:
    """For a stream's batches: each writes what it changed, as rows of its number; every ``compact`` batches all of them are put together.

    A key's row is the last in ``order``, of equal ones the latest batch's; without an order, a batch
    has one row a key. ``merge`` makes one row a key of all batches' rows where they are not states but add up. A batch that runs again writes its rows again. Batches that are put together are deleted
    only after the next one has begun, so a failure in between loses nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        (latest(batch, keys, order) if order else batch).write.mode("overwrite").parquet(f"{folder}/batch={number:09d}")
        if number % compact == compact - 1:
            merged = _one(_numbered(spark, folder, batch.schema.simpleString(), number), keys, order, merge)
            merged.write.mode("overwrite").parquet(f"{folder}/base={number:09d}")
        elif number % compact == 0:
            _forget(spark, folder, number - 1)

    return write


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    """(kind, number, path) of a log's finished parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [(*x.getPath().getName().partition("=")[::2], x.getPath().toString()) for x in system.listStatus(path)]
    return sorted((kind, int(n), at) for kind, n, at in found if kind in ("batch", "base") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")))


def _numbered(spark: SparkSession, folder: str, schema: str, most: int | None = None) -> DataFrame:
    parts = [x for x in _parts(spark, folder) if most is None or x[1] <= most]
    base = max((n for kind, n, _ in parts if kind == "base"), default=-1)
    rows = None
    for kind, n, at in parts:
        if kind == "base" and n == base or kind == "batch" and n > base:
            own = spark.read.parquet(at).withColumn("_batch", F.lit(n).cast("bigint"))
            rows = own if rows is None else rows.unionByName(own)
    return rows if rows is not None else spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("bigint"))


def _forget(spark: SparkSession, folder: str, number: int) -> None:
    """Deletes what the base of ``number`` holds."""
    parts = _parts(spark, folder)
    if ("base", number) in {(kind, n) for kind, n, _ in parts}:
        for kind, n, at in parts:
            if kind == "base" and n < number or kind == "batch" and n <= number:
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _one(rows: DataFrame, keys: list[str], order: list[str], merge: Merge | None) -> DataFrame:
    return merge(rows.drop("_batch")) if merge else latest(rows, keys, [*order, "_batch"]).drop("_batch")


def read_log(spark: SparkSession, folder: str, schema: str, keys: list[str], order: list[str], merge: Merge | None = None) -> DataFrame:
    """The latest row of each key of a log, or what ``merge`` makes of its rows."""
    return _one(_numbered(spark, folder, schema), keys, order, merge)


