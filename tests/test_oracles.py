"""Every registered query against its SQL, row for row."""

import duckdb
import pytest

import __spark_entry__ as entry
from waymesh.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got
    if name in registry.ORACLES:
        con = db.execute(registry.ORACLES[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted((tuple(r[i] for i in at) for r in con.fetchall()), key=str)
        assert len(got) == len(want)
        assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
