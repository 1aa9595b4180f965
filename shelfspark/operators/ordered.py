"""Sums and neighbours along an order, for groups of any size.

Rows are dealt by ranges of (group, order), so that a group of a third of all rows is many
ranges; each range is one task's, and what it has to know of the ranges before it is one row a
range. The ranges are a table of the shared folder, so that a range stays what it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import write_table

_RANGE, _COUNT = "__range", "__count"


def _ranges(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    return write_table(rows.repartitionByRange(group, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def running_totals(rows: DataFrame, group: str, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``number`` (from 1 in its group along ``order``) and, for each of ``sums``, ``before_<name>``: the sum of the group's rows before."""
    taken = _ranges(rows, group, order)
    own = Window.partitionBy(group, _RANGE).orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    start = Window.partitionBy(group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_range = taken.groupBy(group, _RANGE).agg(F.count("*").alias(_COUNT), *(F.sum(x).alias(f"__sum_{x}") for x in sums))
    held = [_COUNT, *(f"__sum_{x}" for x in sums)]
    starts = by_range.select(F.col(group).alias("__group"), F.col(_RANGE).alias("__of"), *(zero(F.sum(x).over(start)).alias(x) for x in held))
    joined = taken.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col(_RANGE) == F.col("__of")))
    totals = {"number": F.col(_COUNT) + F.row_number().over(own), **{f"before_{x}": F.col(f"__sum_{x}") + zero(F.sum(x).over(earlier)) for x in sums}}
    return joined.withColumns(totals).drop("__group", "__of", _RANGE, *held)


def previous(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``is_first`` of its group and ``previous``, the value of the row before it along ``order``."""
    taken = _ranges(rows, group, order)
    own = Window.partitionBy(group, _RANGE).orderBy(*order)
    one = F.struct(F.col(value).alias("v"))
    last = taken.groupBy(F.col(group).alias("__group"), F.col(_RANGE).alias("__of")).agg(F.max_by(one, F.struct(*order)).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(Window.partitionBy("__group").orderBy("__of"))).drop("__last")
    joined = taken.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col(_RANGE) == F.col("__of")))
    found = joined.withColumn("__found", F.coalesce(F.lag(one).over(own), "__before"))
    return found.withColumns({"is_first": F.col("__found").isNull(), "previous": F.col("__found.v")}).drop("__found", "__before", "__group", "__of", _RANGE)
