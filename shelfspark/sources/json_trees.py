"""JSON of any shape, level by level: its entries, counts that it announces, its keys and its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import write_table

ENTRIES = "id, depth, path, key, value, kind"
# Fixed value: keys whose numbers count something.
COUNTING = "(?i)total|count|cantidad|records|filtered"


def entries(feeds: DataFrame, id: str = "url", body: str = "body") -> DataFrame:
    """(id, depth, path, key, value, kind) of every member at any depth of JSON texts; ``key`` is null in lists, broken texts give none.

    ``value`` is a scalar's text, null for objects and lists, whose members are entries of their
    own: nothing is written once a level. A level is one generator over the one before.
    """
    spark = feeds.sparkSession
    level = feeds.select(F.col(id).alias("id"), F.lit("$").alias("path"), F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    out, depth = None, 0
    while True:
        depth += 1
        found = spark.sql("SELECT id, path, e.key AS key, e.pos AS pos, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e", level=level)
        kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        table = write_table(found.select("id", F.lit(depth).alias("depth"), F.concat("path", step).alias("path"), "key", kind.alias("kind"), "v"), "json-level")
        nested = F.col("kind").isin("object", "array")
        own = table.select("id", "depth", "path", "key", F.when(~nested, F.variant_get("v", "$", "string")).alias("value"), "kind")
        out = own if out is None else out.unionAll(own)
        level = table.where(nested).select("id", "path", "v")
        if level.isEmpty():
            return out


def announced_count(found: DataFrame) -> DataFrame:
    """(id, count): the largest number that a counting key of ``entries`` announces; digits alone count."""
    scalar = F.col("kind").isin("string", "bigint", "decimal", "double", "tinyint", "smallint", "int")
    number = F.regexp_replace("value", "[^0-9]", "").try_cast("decimal(38,0)")
    rows = found.where(scalar & F.col("key").rlike(COUNTING)).select("id", number.alias("n")).where("n > 0")
    return rows.groupBy("id").agg(F.max("n").alias("count"))


def keys(found: DataFrame) -> DataFrame:
    """(key, n, ids): how often each key occurs, and in how many texts."""
    return found.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def shape(feeds: DataFrame, body: str = "body") -> DataFrame:
    """One row: the schema that holds all of the texts; broken ones do not count."""
    return feeds.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(body))).alias("shape"))
