"""Queries over whole tables against their SQL, at a larger size."""

import duckdb
import pytest

from palimpsest import queries as core

from .test_queries import plain

SF = "/root/testdata/sf0.01"
NAMES = [
    "changed_prev_neighbourhood", "graph_repeat_until", "sort_multi_nulls_last", "sort_nulls_first_multivalue", "graph_order_by", "model_order_by",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_whole_inputs(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)
