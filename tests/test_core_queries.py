"""Every query with SQL gives DuckDB's rows on the small test tables."""

import duckdb
import pandas as pd
import pytest

from armwise.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "part")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(frame.itertuples(index=False, name=None), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_mllib_runs(spark):
    assert QUERIES["mllib_tree_scores"](spark, DATA).where("score is null").count() == 0
