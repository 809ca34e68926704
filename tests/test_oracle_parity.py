"""Every registered query against its DuckDB oracle on the smallest data set
(the driver repeats this at sf0.01); queries without an oracle must run."""

import duckdb
import pytest

import __spark_entry__ as E
from parley.plans import catalog
from parley.sources.tables import DRIVER_TABLES
from scripts_check import digest, type_mismatches

from conftest import SF_SMALL

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_parity(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert type_mismatches(sdf, cur.description) == []
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["query", "response_a", "response_b", "preference"]
    df.count()
