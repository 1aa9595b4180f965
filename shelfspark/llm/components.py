"""Connected components of a graph given as an edge table, by rounds of large and small stars.

Each round links nodes to the smallest neighbour known; minima are aggregated before the
shuffle, so a hub with very many neighbours costs a row a task, and are tables of their own,
so that adaptive execution can split their join with a hub's edges. Every round's edges are
written to the shared folder, and those of the round before deleted. The number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import drop_tables, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _replaced(linked, edges, least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = write_table(down.groupBy("a").agg(F.min("b").alias("least")), "least")
    rest = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _replaced(rest.union(least.select("a", F.col("least").alias("b"))), edges, least)


def _replaced(linked: DataFrame, *used: DataFrame) -> DataFrame:
    """The distinct edges as the next table, in place of those they were made of."""
    table = write_table(linked.distinct(), "edges")
    drop_tables(*used)
    return table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge in ``edges`` (a, b: long); the component is its smallest node."""
    now = write_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = _small_star(_large_star(now))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
