"""Every query with a counterpart in SQL against DuckDB over the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_query(spark, sf_dir, duck, name):
    cursor = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    df = QUERIES[name](spark, sf_dir)
    assert columns == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want and want is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_keys_match():
    assert set(ORACLES) <= set(QUERIES)
