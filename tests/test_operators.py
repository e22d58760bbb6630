"""Predicates, transactions, dateback, commits, indices on small inline data."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import numbers
from palimpsest.functions.compare import P
from palimpsest.functions.predicates import PredicateError, where
from palimpsest.operators import graph_history as gh
from palimpsest.operators import transactions as tx
from palimpsest.operators.commitlog import CommitLog
from palimpsest.operators.dateback import Dateback
from palimpsest.operators.indexing import DirtyIndex, IndexManager, Query, SortKey
from palimpsest.plans.branches import Branch, BranchTree
from palimpsest.plans.versions import VersionLog

SCHEMA = "branch string, keyspace string, key string, ts long, op string, name string, tags array<string>, n long, x double"


@pytest.fixture()
def log(spark):
    rows = [
        ("master", "default", "a", 1, "P", "Hello\n", ["red", "Blue"], 5, 1.0),
        ("master", "default", "b", 1, "P", "hello", [], None, 1.05),
        ("master", "default", "c", 1, "P", " ", ["green"], 7, None),
        ("master", "default", "d", 1, "P", None, None, -3, 2.5),
    ]
    return VersionLog(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture()
def indices(log):
    m = IndexManager(log)
    for name, kind in (("name", "string"), ("tags", "string"), ("n", "long"), ("x", "double")):
        m.create(name, kind, name, assume_no_prior_values=True)
    return m


def keys(indices, condition):
    return "".join(sorted(r["key"] for r in Query(indices).where(condition).get_keys().collect()))


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (where("name").is_equal_to("hello"), "b"),
        (where("name").is_equal_to_ignore_case("HELLO"), "b"),
        (where("name").matches_regex("hell."), "b"),
        (where("name").matches_regex_ignore_case("HELLO"), "b"),
        (where("name").not_matches_regex("hell."), "acd"),
        (where("name").is_not_equal_to("hello"), "acd"),
        (where("tags").contains("e"), "ac"),
        (where("tags").not_contains("e"), "bd"),
        (where("tags").starts_with_ignore_case("b"), "a"),
        (where("tags").in_strings(set()), ""),
        (where("tags").not_in_strings(set()), "abcd"),
        (where("n").is_greater_than(4), "ac"),
        (~where("n").is_greater_than(4), "d"),
        (where("n").is_not_equal_to(5), "bcd"),
        (~~where("n").is_equal_to(5), "a"),
        (where("x").is_equal_to(1.0, 0.1), "ab"),
        (where("x").is_not_equal_to(1.0, 0.1), "cd"),
        (where("x").in_doubles({2.4}, -0.2), "d"),
        (~(where("n").is_less_than(6) & where("x").is_greater_than(0.5)), "c"),
        (where("n").is_not_equal_to(5) | where("n").is_not_equal_to(7), "abcd"),
    ],
)
def test_conditions(indices, condition, want):
    assert keys(indices, condition) == want


def test_wrong_conditions(indices, log):
    with pytest.raises(PredicateError):
        Query(indices).where(where("n").is_equal_to("5")).rows()
    with pytest.raises(PredicateError):
        Query(indices).where(where("nothing").contains("5")).rows()
    with pytest.raises(PredicateError):
        where("x").is_equal_to(1.0, -1.0)
    fresh = IndexManager(log)
    fresh.create("n", "long", "n")
    with pytest.raises(DirtyIndex):
        Query(fresh).where(where("n").is_equal_to(5)).rows()
    fresh.reindex_all()
    assert Query(fresh).where(where("n").is_equal_to(5)).count().first()["n"] == 1
    with pytest.raises(ValueError):
        fresh.create("n", "long", "n")


def test_indices_are_inherited(log):
    log = VersionLog(log.rows, BranchTree([Branch("master"), Branch("dev", "master", 5)]))
    m = IndexManager(log)
    m.create("n", "long", "n", valid_from=0, valid_to=4, assume_no_prior_values=True)
    assert "n" not in m.find("dev") and "n" in m.find("dev", 3)
    m.create("n", "long", "x", branch="dev", assume_no_prior_values=True)
    assert m.find("dev")["n"].branch == "dev"


def test_sorting(indices):
    def order(*by):
        return "".join(r["key"] for r in Query(indices).sort_by(*by).rows().collect())

    assert order(SortKey("n")) == "dacb"
    assert order(SortKey("n", descending=True)) == "cadb"
    assert order(SortKey("n", nulls_first=True)) == "bdac"
    assert order(SortKey("tags", ignore_case=True), SortKey("n")) == "acdb"


def test_collections_in_graph_predicates(spark):
    df = spark.createDataFrame([(["a", "b"], 3), (["b"], None), ([], 5), (None, 7)], "t array<string>, n int")

    def hits(test, col, is_array):
        return [r[0] for r in df.select(test(F.col(col), is_array)).collect()]

    assert hits(P.eq("b"), "t", True) == [True, True, False, False]
    assert hits(P.neq("b"), "t", True) == [False, False, False, False]
    assert hits(P.eq(["a", "b"]), "t", True) == [True, False, False, False]
    assert hits(P.within("b", "z"), "t", True) == [True, True, False, False]
    assert hits(P.eq(3.0), "n", False) == [True, False, False, False]
    assert hits(P.neq(3), "n", False) == [False, False, True, True]
    assert hits(P.eq(3, 0.0), "n", False) == [False] * 4
    assert hits(P.between(3, 7), "n", False) == [True, False, True, False]
    assert hits(P.matches_regex("[ab]"), "t", True) == [True, True, False, False]


def test_numbers(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (-2.6,), (300.9,)], "x double")
    assert [r[0] for r in df.select(numbers.round_half_up(F.col("x"))).collect()] == [3, -2, -3, 301]
    assert [r[0] for r in df.select(numbers.as_number(F.col("x"), "byte")).collect()] == [2, -2, -2, 44]
    some = spark.createDataFrame([(1.5,), (None,), (2.0,)], "x double")
    assert some.agg(numbers.mean_over_all(F.col("x"))).first()[0] == pytest.approx(3.5 / 3)
    assert some.agg(numbers.sum_as_long(F.col("x"))).first()[0] == 3


SMALL = "branch string, keyspace string, key string, ts long, op string, v int"


@pytest.fixture()
def small(spark):
    rows = [("master", "default", "a", 10, "P", 1), ("master", "default", "b", 10, "P", 2), ("master", "default", "b", 20, "P", 3), ("master", "default", "c", 20, "D", None)]
    return VersionLog(spark.createDataFrame(rows, SMALL))


def state(log, ts=(1 << 63) - 1):
    return {r["key"]: r["v"] for r in log.snapshot("master", ts).collect()}


def test_commits(small):
    store = tx.Store(small)
    t = store.tx()
    assert t.commit() == -1
    t.put("a", (1,))
    t.remove("nothing")
    assert t.commit() == -1, "nothing changes"
    t.put("a", (7,))
    t.put("a", (8,))
    t.remove("b")
    assert t.get("a").first()["v"] == 1, "own changes are not seen"
    first = t.commit("note")
    assert state(store.log) == {"a": 8}
    assert state(store.log, first - 1) == {"a": 1, "b": 3}
    assert store.commits == [("master", first, "note", False)]
    with pytest.raises(ValueError):
        t.put("x", None)
    other = store.tx()
    other.put("x", (1,))
    other.rollback()
    assert other.commit() == -1
    assert store.next_ts("master") > first


def test_incremental_commits(small):
    store = tx.Store(small)
    t = store.tx()
    t.put("p", (1,))
    ts = t.commit_incremental()
    assert "p" not in state(store.log)
    t.put("q", (2,))
    t.put("p", (3,))
    assert t.commit_incremental() == ts
    assert t.commit() == ts
    assert state(store.log) == {"a": 1, "b": 3, "p": 3, "q": 2}


@pytest.mark.parametrize(("strategy", "b", "a"), [(tx.OVERWRITE_WITH_SOURCE, 9, 5), (tx.OVERWRITE_WITH_TARGET, 3, 5), (lambda s, t, o: F.struct(s["op"].alias("op"), (s["v"] + t["v"] + o["v"]).alias("v")), 14, 5)])
def test_conflicts(small, strategy, b, a):
    store = tx.Store(small, strategy)
    t = store.tx(ts=15)
    t.put("b", (9,))
    t.put("a", (5,))
    assert t.commit() > 20
    assert state(store.log) == {"a": a, "b": b}


def test_conflicts_that_fail(small):
    store = tx.Store(small)
    t = store.tx(ts=15)
    t.put("b", (9,))
    with pytest.raises(tx.CommitConflict):
        t.commit()
    assert state(store.log) == {"a": 1, "b": 3}
    with pytest.raises(PermissionError):
        tx.Store(small, read_only=True).write(small.rows.select("keyspace", "key", "op", "v"), "master", None)
    with pytest.raises(ValueError):
        tx.Store(small, metadata_filter=lambda b, t, m: m is not None).write(small.rows.select("keyspace", "key", "op", "v"), "master", None)


def test_triggers_and_rules(small):
    store, seen = tx.Store(small), []
    hooks = gh.Triggers()
    hooks.create("low", gh.PRE_COMMIT, lambda c: seen.append("low"), 1)
    hooks.create("high", gh.PRE_COMMIT, lambda c: seen.append("high"), 9)
    hooks.create("double", gh.PRE_PERSIST, lambda c: c.changes.withColumn("v", F.col("v") * 2))
    hooks.create("after", gh.POST_COMMIT, lambda c: seen.append("after"))
    t = store.tx()
    t.put("a", (21,))
    gh.commit_with_hooks(t, hooks, [gh.Rule("positive", lambda: F.col("v") > 0)])
    assert seen == ["high", "low", "after"] and state(store.log)["a"] == 42
    t = store.tx()
    t.put("a", (-1,))
    with pytest.raises(gh.CancelCommit, match="positive: a"):
        gh.commit_with_hooks(t, hooks, [gh.Rule("positive", lambda: F.col("v") > 0)])
    assert state(store.log)["a"] == 42 and hooks.drop("after") and not hooks.drop("after")


def test_dateback(spark, small):
    assert state(Dateback(small).purge_entry("b", 20)) == {"a": 1, "b": 2}
    assert state(Dateback(small).purge_commits(10)) == {"b": 3}
    assert state(Dateback(small).purge_keyspace("default", 15)) == {"a": 1, "b": 2}
    d = Dateback(small)
    late = spark.createDataFrame([("default", "z", 15, "P", 4), ("default", "a", 10, "P", 99)], "keyspace string, key string, ts long, op string, v int")
    assert state(d.inject(late)) == {"a": 1, "b": 3, "z": 4}
    assert state(d.inject(late, override=True)) == {"a": 99, "b": 3, "z": 4}
    assert d.untouched_until == 9 and d.snapshot(100).count() == 0
    assert [o[0] for o in d.operations(affecting=12)] == ["inject", "inject"]
    d = Dateback(small)
    assert state(d.transform_values_of_key("b", lambda n, c: c + 100)) == {"a": 1, "b": 103}
    assert state(d.transform_commit(10, lambda n, c: c * 0), 15) == {"a": 0, "b": 0}
    commits = spark.createDataFrame([("master", 10, "old", False)], "branch string, ts long, metadata string, internal boolean")
    assert d.update_commit_metadata(commits, 10, "new").first()["metadata"] == "new"


def test_commit_log(spark):
    rows = [("master", t, str(t), t % 5 == 0) for t in range(1, 13)] + [("dev", 20, "dev", False)]
    c = CommitLog(spark.createDataFrame(rows, "branch string, ts long, metadata string, internal boolean"), BranchTree([Branch("master"), Branch("dev", "master", 15)]))

    def ts(df):
        return [r["ts"] for r in df.collect()]

    assert ts(c.between(4, 8)) == [8, 7, 6, 4]
    assert ts(c.between(4, 8, internal=True, ascending=True)) == [4, 5, 6, 7, 8]
    assert ts(c.between(8, 4)) == []
    assert ts(c.paged(1, 12, 3, 1)) == [8, 7, 6]
    assert ts(c.before(6, 3)) == [4, 3, 2]
    assert ts(c.after(6, 3)) == [9, 8, 7]
    assert ts(c.around(6, 5)) == [8, 7, 6, 4, 3]
    assert ts(c.around(2, 5)) == [6, 4, 3, 2, 1]
    assert ts(c.around(12, 4)) == [12, 11, 9, 8]
    assert ts(c.around(100, 3)) == [12, 11, 9]
    assert c.count().first()["n"] == 10 and c.count_between(7, 7).first()["n"] == 1
    assert c.metadata_at(12, "dev").first()["metadata"] == "12"
    assert ts(c.between(1, 12, "dev")) == []
