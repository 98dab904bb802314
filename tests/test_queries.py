"""Every registered query with an SQL twin must agree with DuckDB; the others must run."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as driver
from catalog.base import TABLES
from check import rows_of

DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, DIR)
    cur = duck.execute(SQL[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(SQL)))
def test_runs(spark, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_sweep_and_embedding_are_whole(spark):
    from catalog import base, clusters, reduction
    from loomstat.operators import kmeans, pca
    small = "/root/testdata/sf0.001"
    assert sorted(r.k for r in clusters.silhouette_sweep(spark, small).collect()) == list(range(2, kmeans.MAX_SWEEP + 1))
    ratios = pca.explained_variance(pca.fit_pca(base.vectors(spark, small), k="auto"), spark).count()
    assert ratios > 2
    assert reduction.pca_embed(spark, small).columns == ["vec_id", *[f"PC{i + 1}" for i in range(ratios)]]
