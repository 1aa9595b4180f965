"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shelfspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Parts that ``spread`` makes for each core.
PARTS_A_CORE = 4


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by columns to tasks for all cores.

    Tasks are cut by bytes. Where each of many short rows costs a lot (patterns, pages), a table of
    few bytes would be a single task; what is dealt by a number of parts stays that many.
    """
    spark = rows.sparkSession
    parts = max(PARTS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *by)


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def write_table(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again; ``options`` are the writer's.

    This cuts the lineage: what follows survives the loss of any executor without
    recomputing, and row ids made before the write stay as they are.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of ``write_table`` that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, _paths.pop(table)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
