"""Reads of the version log against a small model in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.period import FOREVER, Period
from palimpsest.plans.branches import Branch, BranchTree
from palimpsest.plans.versions import VersionLog

TREE = BranchTree([Branch("master"), Branch("dev", "master", 40), Branch("exp", "dev", 70), Branch("side", "master", 20)])


@pytest.fixture(scope="module")
def script():
    rng = random.Random(13)
    cells = {}
    for _ in range(500):
        branch = rng.choice(["master", "master", "dev", "exp", "side"])
        ts = rng.randint(TREE.get(branch).branching_ts + 1, 120)
        key = (branch, rng.choice(["default", "other"]), f"k{rng.randint(0, 12)}", ts)
        cells[key] = ("D", None) if rng.random() < 0.25 else ("P", rng.randint(0, 9))
    return cells


@pytest.fixture(scope="module")
def log(spark, script):
    rows = [(*k, *v) for k, v in script.items()]
    return VersionLog(spark.createDataFrame(rows, "branch string, keyspace string, key string, ts long, op string, value int"), TREE)


def find(script, branch, keyspace, key, ts):
    """(branch, ts, op, value) of the version that a read sees, going up the tree."""
    own = [(t, v) for (b, s, k, t), v in script.items() if (b, s, k) == (branch, keyspace, key) and t <= ts]
    if own:
        t, v = max(own)
        return branch, t, *v
    b = TREE.get(branch)
    return find(script, b.origin, keyspace, key, min(ts, b.branching_ts)) if b.origin else None


def snapshot(script, branch, ts):
    keys = {(s, k) for _, s, k, _ in script}
    found = {x: find(script, branch, *x, ts) for x in keys}
    return {x: (f[0], f[1], f[3]) for x, f in found.items() if f and f[2] == "P"}


@pytest.mark.parametrize("branch", ["master", "dev", "exp", "side"])
@pytest.mark.parametrize("ts", [0, 20, 21, 40, 41, 70, 71, 119, FOREVER])
def test_snapshots(log, script, branch, ts):
    got = {(r["keyspace"], r["key"]): (r["branch"], r["ts"], r["value"]) for r in log.snapshot(branch, ts).collect()}
    assert got == snapshot(script, branch, ts)


def test_single_reads(spark, log, script):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(14)], "key string")
    for branch, ts in (("exp", 90), ("dev", 60)):
        want = {k: v for (s, k), v in snapshot(script, branch, ts).items() if s == "default"}
        assert {r["key"] for r in log.key_set(branch=branch, ts=ts).collect()} == set(want)
        assert {r["key"]: r["exists"] for r in log.exists(keys, branch=branch, ts=ts).collect()} == {f"k{i}": f"k{i}" in want for i in range(14)}
        for r in log.last_modification(keys, branch=branch, ts=ts).collect():
            f = find(script, branch, "default", r["key"], ts)
            assert r["last_modified"] == (f[1] if f else -1)
    assert log.get("nothing").count() == 0


def test_validity_gives_every_snapshot(log, script):
    v = log.validity("exp").collect()
    for ts in (10, 39, 40, 41, 69, 70, 71, 100, 120):
        got = {(r["keyspace"], r["key"]): r["value"] for r in v if r["valid_from"] <= ts < r["valid_to"] and r["op"] == "P"}
        assert got == {k: x[2] for k, x in snapshot(script, "exp", ts).items()}


def test_ranged_get_covers_missing_values(spark, log, script):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(14)], "key string")
    for r in log.ranged_get(keys, branch="dev", ts=60).collect():
        f = find(script, "dev", "default", r["key"], 60)
        assert r["value"] == (f[3] if f and f[2] == "P" else None)
        assert r["valid_from"] <= 60 < r["valid_to"]
        if r["key"] == "k13":
            assert (r["valid_from"], r["valid_to"]) == (0, FOREVER)


def test_history(log, script):
    want = {t for (b, s, k, t) in script if (s, k) == ("default", "k3") and ((b == "exp" and t <= 100) or (b == "dev" and t <= 70) or (b == "master" and t <= 40))}
    got = [r["ts"] for r in log.history("k3", branch="exp", ts=100).collect()]
    assert got == sorted(want, reverse=True)
    assert [r["ts"] for r in log.history("k3", branch="exp", ts=100, lo=30, hi=80, ascending=True).collect()] == sorted(t for t in want if 30 <= t <= 80)


def test_rollover_keeps_later_reads(log, script):
    rolled = log.rollover(60, "master")
    late = VersionLog(rolled.rows.filter((F.col("branch") != "master") | (F.col("ts") >= 60)), TREE)
    got = {(r["keyspace"], r["key"]): r["value"] for r in late.snapshot("master", 110).collect()}
    want = {k: v[2] for k, v in snapshot(script, "master", 110).items()}
    assert got == want


def test_branch_tree():
    t = BranchTree([Branch("master"), Branch("a", "master", 10), Branch("b", "a", 20)])
    assert t.children("master", True) == ["a", "b"]
    assert [t.actual_branch("b", x) for x in (5, 10, 11, 20, 21)] == ["master", "master", "a", "a", "b"]
    with pytest.raises(ValueError):
        t.create("a")
    with pytest.raises(ValueError):
        t.create("c", "nowhere")
    with pytest.raises(ValueError):
        t.delete_recursively("master")
    assert t.delete_recursively("a") == ["a", "b"] and t.names() == ["master"]


def test_periods(spark):
    rng = random.Random(5)
    rows = [tuple(rng.randint(0, 6) for _ in range(4)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    p, q = Period(F.col("a"), F.col("b")), Period(F.col("c"), F.col("d"))
    got = df.select("*", p.overlaps(q).alias("o"), p.contains(q).alias("i"), p.adjacent_to(q).alias("j"), p.strictly_before(q).alias("s"), p.intersection(q).length().alias("n"), p.contains(3).alias("t"))
    for r in got.collect():
        x, y = set(range(r["a"], r["b"])), set(range(r["c"], r["d"]))
        assert r["o"] == bool(x & y)
        assert r["i"] == (bool(x) and bool(y) and y <= x)
        assert r["j"] == (bool(x) and bool(y) and (r["a"] == r["d"] or r["b"] == r["c"]))
        assert r["s"] == (bool(x) and bool(y) and r["b"] <= r["c"])
        assert r["n"] == len(x & y)
        assert r["t"] == (3 in x)


def test_filters_reach_the_scan(spark, log, tmp_path):
    from palimpsest.sources.store_io import read_log, write_log

    write_log(log, f"file://{tmp_path}/log")
    plan = read_log(spark, f"file://{tmp_path}/log").get("k1", branch="dev", ts=50)._jdf.queryExecution().toString()
    assert "EqualTo(key,k1)" in plan and "LessThanOrEqual(ts,50)" in plan
