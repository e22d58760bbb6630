"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest import queries as core

SF = "/root/testdata/sf0.001"
NAMES = [
    "kv_snapshot_where_eq", "kv_ranged_get", "kv_asof_join", "branch_snapshot_exp", "kv_history_desc", "commits_around", "pred_not_contains_ci",
    "pred_double_within_tol", "sort_multi_nulls_last", "dup_version_elim", "conflict_custom", "dateback_transform_entry", "graph_cp_many_to_many",
    "graph_closure", "graph_coalesce", "restore_diff", "changed_prev_neighbourhood", "model_all_contents", "model_evolution",
    "store_durable_commits", "store_durable_stale_head", "dump_full", "dump_audit_and_indices", "backup_after_dateback", "graph_io_graphml",
    "xmi_links", "tx_triggers", "dateback_dirty_indices", "graph_index_query", "iterate_all_elements", "iterate_changed_neighbours",
    "model_at", "graph_merge_vertices", "graph_merge_edges", "graph_lifecycle", "graph_match", "graph_cyclic_path", "stream_append",
    "stream_windows_late", "model_rounding",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())
    assert set(core.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "ts", "value"]
