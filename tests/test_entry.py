"""The driver contract, and every registered query against its DuckDB oracle."""

from __future__ import annotations

import os

import pytest

from helpers import ROOT, SF_SMALL

import __spark_entry__ as E  # noqa: E402
from jobmix.plans import registry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["total_jobs", "jobs_all_purpose", "jobs_classic", "jobs_serverless",
                          "pct_serverless", "pct_all_purpose", "pct_classic"]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, key):
    import sys
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from oracle_check import canon

    df = E.queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert canon(df.columns, s_rows) == canon(o_cols, o_rows)
