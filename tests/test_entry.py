import duckdb
import pytest

import __spark_entry__ as entry
from sparkwright.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return tuple(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in got.select(*cols).collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        assert rows == sorted(repr([plain(v) for v in r]) for r in rel.select(*cols).fetchall())
    else:
        assert rows
