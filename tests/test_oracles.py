"""Every query of the library's own operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from quire import queries

SF = "/root/testdata/sf0.001"
ORACLE = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    picked = ", ".join(f'"{c}"' for c in cols)
    b = sorted(tuple(map(plain, r)) for r in duck.sql(f"select {picked} from ({ORACLE[name]})").fetchall())
    a = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
