"""Each query of the registry against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from scriptorium.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    query = QUERIES[name]
    df = query.run(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got
    if query.sql:
        cursor = db.execute(query.sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        rows = cursor.fetchall()
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=key)
        assert got == expected
