"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyloom.plans import registry


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        f = round(float(v), 5)
        return int(f) if f.is_integer() else f
    return v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(str(plain(v)) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, tiny, name):
    found = registry.QUERIES[name](spark, tiny).toPandas()
    assert len(set(found.columns)) == len(found.columns)
    if name in registry.ORACLE_SQL:
        assert rows(found) == rows(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
