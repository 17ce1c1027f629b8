"""Every registered query with a SQL twin gives the twin's rows on the small tables."""

import math

import duckdb
import pytest

from gridcanopy.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    cur = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    want = sorted(cur.fetchall(), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, abs_tol=2e-6)), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
