"""Every registered query against its DuckDB statement (sf0.001)."""

import pytest

import __spark_entry__ as entry
import oracle_sql
from check_oracle import duck, rows_of
from ragchew import registry

QUERIES = registry.queries()
ORACLE = oracle_sql.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, small_dir, name):
    import pandas as pd
    sdf = QUERIES[name](spark, small_dir)
    sp = pd.DataFrame([r.asDict(recursive=True) for r in sdf.collect()], columns=sdf.columns)
    dk = con.execute(ORACLE[name]).fetchdf()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "score" in df.columns
