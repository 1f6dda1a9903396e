"""Every registered query of the library against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from arborweb import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", queries.NAMES)
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name not in oracles.SQL:
        assert got
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracles.SQL[name]})").fetchall()
    assert plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(oracles.SQL) <= set(queries.NAMES)


def test_the_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
