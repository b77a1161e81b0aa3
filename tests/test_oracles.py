"""Every query against its SQL in DuckDB, whole results compared."""

import duckdb
import pytest

from residua import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    ours = catalog.queries()[name](spark, sf_dir)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    named = ", ".join(f'"{c}"' for c in columns)
    assert plain(ours.select(columns).collect()) == plain(theirs.project(named).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
