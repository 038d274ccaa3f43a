"""What SQL does not say of the drawings: every line of an order has its box."""

import os

import duckdb
import pytest

from quire import queries

from .test_oracles import SF
@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def test_svg_holds_every_line(spark, duck):
    svgs = queries.queries()["layout_svg"](spark, SF).collect()
    want = dict(duck.sql("select l_orderkey, count(distinct l_linenumber) from lineitem group by 1").fetchall())
    assert {r["doc_id"]: r["svg"].count("<rect") for r in svgs} == want
