"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark import catalog, evaluation, modelling  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected.columns, expected.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
