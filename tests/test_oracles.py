"""Queries against their SQL in DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quantjobs.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Decisions that hold sums and differences of weights against limits are compared on more rows, too.
DECISIONS = ["rb10_execution_plan", "rb11_sector_drift", "rb12_stable_frontier"]
NAMES = sorted(registry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else float(v) if hasattr(v, "as_tuple") else v


def views(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def con():
    return {folder: views(folder) for folder in (SF, LARGER)}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name,folder", [(n, SF) for n in NAMES] + [(n, LARGER) for n in DECISIONS])
def test_query_equals_sql(spark, con, name, folder):
    df = registry.queries()[name](spark, folder)
    rel = con[folder].sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
