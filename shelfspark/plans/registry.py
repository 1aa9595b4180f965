"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import discovery, sites

FLAGSHIP = "inventory_page"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**sites.QUERIES, **discovery.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**sites.SQL, **discovery.SQL}
