"""Every registered query against its DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tessera.sources.tables import TABLES
from tools.check_oracles import rows_of

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_name_and_most_have_an_oracle():
    assert len(QUERIES) >= 100
    missing = sorted(n for n in set(QUERIES) - set(ORACLES) if n != "pipeline" and not n.startswith("op"))
    assert missing == ["sample_check"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["uri", "block"]
