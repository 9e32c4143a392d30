"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) and not math.isnan(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
