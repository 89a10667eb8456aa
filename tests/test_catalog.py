"""Every query of the case-record library against its DuckDB statement on the same tables."""

import duckdb
import pytest

from docketry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def _sorted(rows):
    return sorted([tuple(_plain(x) for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    con = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted(tuple(r[c] for c in columns) for r in df.collect()) == _sorted(con.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
