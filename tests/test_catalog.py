"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from alnquant import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.10g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) or "" for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) or "" for c in cols) for r in got.collect()) == want
