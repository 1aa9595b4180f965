"""Every query against its SQL over whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from shelfspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir)
    rows = sorted(([plain(r[c]) for c in sorted(got.columns)] for r in got.collect()), key=repr)
    sql = entry.oracle_sql()[name]
    columns = sorted(d[0] for d in con.execute(sql).description)
    assert columns == sorted(got.columns)
    want = sorted(([plain(v) for v in r] for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)
    assert rows == want
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
