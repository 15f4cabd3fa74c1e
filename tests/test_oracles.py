"""Every query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from canopy import queries, queries_crowns, queries_fields, queries_files  # noqa: F401


def rows(frame, columns):
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


#: 15 individuals, as in the smallest tables, leave no split.
LARGER = {"split_best": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    sf_dir = LARGER.get(name, sf_dir)
    ours = queries.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    theirs = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(theirs.columns)) == rows(theirs, sorted(theirs.columns))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
