"""Every query of the library against its SQL."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert rows(got).equals(rows(want))
