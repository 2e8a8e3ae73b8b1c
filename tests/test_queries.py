"""Every registered query beside its SQL, on the smallest tables, and the entry point."""

import glob
import os

import duckdb
import pytest

from edgeprobe.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def plain(df):
    df = df[sorted(df.columns)]
    rows = df.astype(object).where(df.notna(), None).values.tolist()
    return sorted(rows, key=lambda r: [("" if x is None else x) if isinstance(x, str) or x is None else f"{x:+.4f}" for x in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    if name in ("walk_forward_folds", "purge_counts"):
        pytest.skip("too few bars for folds at this scale")
    ours, theirs = plain(catalog.QUERIES[name](spark, DATA).toPandas()), plain(con.execute(catalog.SQL[name]).df())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) < 2e-6), (a, b)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "sharpe" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
