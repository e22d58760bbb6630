"""Joins over the graph are dealt over tasks whose rows don't grow with the input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import queries as core
from palimpsest import store_queries
from palimpsest.operators.graph import add_vertices
from palimpsest.plans import pieces as P
from palimpsest.sources import derived as D

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(monkeypatch):
    """The smallest tables count as large ones."""
    monkeypatch.setattr(P, "PIECE", 4096)
    monkeypatch.setattr(P, "SMALL", 0)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def most_rows(df):
    """The rows of the largest task, and all."""
    n = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(n), sum(n)


def test_joined_edges_are_dealt_by_bytes(spark, large):
    most, all_ = most_rows(D.graph(spark, SF).edges.filter("label = 'bought'"))
    assert most < all_ / 12, "4 tasks before, whatever the size"


def test_dangling_edges_send_no_table_to_all(spark, large):
    g = D.graph(spark, SF)
    g.vertices = g.vertices.filter("label <> 'region'")
    bad = g.dangling_edges()
    assert plan(bad).count("BroadcastHashJoin LeftAnti") == 0
    assert {r[0] for r in bad.collect()} == {f"o{i}" for i in range(25)}


def test_new_elements_are_held_against_ids_that_they_ask_for(spark, large):
    g = D.graph(spark, SF)
    new = add_vertices(g, spark.createDataFrame([("x1", "nation")], "id string, label string")).vertices
    assert "BroadcastHashJoin LeftOuter" not in plan(new), "all ids went to every task"
    assert new.filter("id = 'x1'").count() == 1


def test_write_checks_collect_no_elements(spark, monkeypatch):
    taken = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: taken.append(1) or collect(df))
    assert core.queries()["graph_write_checks"](spark, SF).count() == 3
    assert not taken


def test_a_step_onto_an_edge_takes_its_columns_along(spark):
    g = D.graph(spark, SF)
    onto = g.V("n5").as_("n").both_e()
    assert plan(onto.other_v("n").rows).count("livesIn") == plan(onto.rows).count("livesIn"), "the edges were joined again"


@pytest.fixture
def rows_of_files(spark, large, monkeypatch, tmp_path):
    """The bought edges in the fullest file that a query writes, and in all, once its result is that of the SQL."""
    def run(name):
        monkeypatch.setattr(store_queries, "shared_folder", lambda _: f"file://{tmp_path}")
        got = core.queries()[name](spark, SF)
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem".split():
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(f"select {', '.join(got.columns)} from ({core.oracle_sql()[name]})").fetchall()
        assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in got.collect())
        path = f"file://{tmp_path}/edges"
        rows = spark.read.parquet(path).select("label") if name == "graph_io_parquet" else spark.read.text(path)
        n = [r[1] for r in rows.filter(rows[0].contains("bought")).groupBy(F.input_file_name()).count().collect()]
        return max(n), sum(n)

    return run


@pytest.mark.parametrize("name", ["graph_dump", "graph_io_graphml", "graph_io_graphml_edges", "graph_io_parquet"])
def test_files_of_edges_are_written_by_tasks_by_bytes(rows_of_files, name):
    most, all_ = rows_of_files(name)
    assert most < all_ / 12, "one file before"


def test_counts_of_edges_come_from_tasks_by_bytes(spark, large):
    got = core.queries()["graph_all_edges"](spark, SF)
    n = P.pieces(D.table(spark, SF, "lineitem"), D.table(spark, SF, "orders"))
    assert n > 12 and plan(got).count(f", {n}), REPARTITION_BY_NUM") == 2, "no table was dealt before"
    edges = D.graph(spark, SF).edges
    assert {tuple(r) for r in got.collect()} == set(Counter(r[0] for r in edges.select("label").collect()).items())
