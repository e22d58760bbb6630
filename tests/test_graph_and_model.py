"""Traversals, closures, models, files, streams."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.compare import P
from palimpsest.operators import graph_history as gh
from palimpsest.operators.graph import Graph, add_edges, add_vertices, remove_vertices
from palimpsest.operators.model import EClass, Feature, Metamodel, Model, delete_cascade
from palimpsest.plans.branches import Branch, BranchTree
from palimpsest.plans.versions import VersionLog
from palimpsest.sources import store_io, xmi
from palimpsest.streaming import log_stream


def make(spark, edges, labels=None):
    ids = sorted({x for a, _, b in edges for x in (a, b)})
    v = spark.createDataFrame([(i, (labels or {}).get(i, "x"), i) for i in ids], "id string, label string, name string")
    e = spark.createDataFrame([(f"e{n}", r, a, b) for n, (a, r, b) in enumerate(edges)], "id string, label string, src string, dst string")
    return Graph(v, e)


def its(t):
    return sorted(r["it"] for r in t.rows.collect())


def test_acyclic_closure(spark):
    chain = [("app", "runsOn", "m1"), ("m1", "runsOn", "m2"), ("m2", "runsOn", "m3"), ("m2", "runsOn", "m4")]
    chain += [(f"m{3 + i % 2}", "runsOn", f"m{5 + i}") for i in range(4)] + [(f"m{5 + i}", "runsOn", f"pm{i}") for i in range(4)]
    g = make(spark, chain, {f"pm{i}": "machine" for i in range(4)})
    found = g.V("app").closure(lambda t: t.out("runsOn"))
    assert its(found.has_label("machine")) == ["pm0", "pm1", "pm2", "pm3"]
    assert len(its(found)) == 12


def test_cyclic_closure_leaves_out_its_start(spark):
    ring = [(f"v{i}", "to", f"v{i % 4 + 1}") for i in range(1, 5)]
    ring += [x for i in range(1, 5) for x in ((f"v{i}", "to", f"v{i + 4}"), (f"v{i + 4}", "to", f"v{i}"))]
    g = make(spark, ring)
    assert its(g.V("v1").closure(lambda t: t.out("to"))) == [f"v{i}" for i in range(2, 9)]


def test_steps(spark):
    g = make(spark, [("a", "r", "b"), ("a", "r", "b"), ("b", "r", "c"), ("c", "s", "a")])
    assert its(g.V("a").out()) == ["b", "b"]
    assert its(g.V("b").both()) == ["a", "a", "c"]
    assert its(g.V("a").out_e().in_v().dedup()) == ["b"]
    assert its(g.V().where(lambda t: t.out("s"))) == ["c"]
    assert its(g.V().not_(lambda t: t.out("s"))) == ["a", "b"]
    assert its(g.V().or_(lambda t: t.has_id("a"), lambda t: t.out("s"))) == ["a", "c"]
    assert its(g.V("a").as_("x").out().select("x")) == ["a", "a"]
    assert its(g.V("a", "c").coalesce(lambda t: t.out("s"), lambda t: t.out("r"))) == ["a", "b", "b"]
    assert its(g.V().has("name", P.within("a", "c")).values("name")) == ["a", "c"]
    assert [r["path"] for r in g.V("c").simple_paths(lambda t: t.out(), 3).dropDuplicates(["path"]).orderBy(F.size("path")).collect()] == [["c", "a"], ["c", "a", "b"]]
    with pytest.raises(TypeError):
        g.V(1)


def test_mutation(spark):
    g = make(spark, [("a", "r", "b"), ("b", "r", "c")])
    g2 = add_vertices(g, spark.createDataFrame([("d", "x")], "id string, label string"))
    loose = spark.createDataFrame([("n", "r", "d", "zz")], "id string, label string, src string, dst string")
    with pytest.raises(Exception, match="an end is missing: n"):
        add_edges(g2, loose).edges.collect()
    g2 = add_edges(g2, loose, check=False)
    assert [r["id"] for r in g2.dangling_edges().collect()] == ["n"]
    with pytest.raises(Exception, match="the vertex exists"):
        add_vertices(g, spark.createDataFrame([("a", "x")], "id string, label string")).vertices.collect()
    left = remove_vertices(g, spark.createDataFrame([("b",)], "id string"))
    assert left.vertices.count() == 2 and left.edges.count() == 0


@pytest.fixture()
def family(spark):
    mm = Metamodel()
    person = [Feature("name", "attribute"), Feature("age", "attribute"), Feature("friend", "reference", True), Feature("child", "reference", True), Feature("married", "reference")]
    mm.register(EClass("Being", "p"), EClass("Person", "p", ("Being",), tuple(person)), EClass("Child", "p", ("Person",)), uri="urn:p")
    objects = [("john", "Person", "John", 40), ("jane", "Person", "Jane", 38), ("jack", "Person", "Jack", None), ("sarah", "Child", "Sarah", 7), ("jp", "Child", "JP", 9)]
    links = [("john", "jane", "married", None), ("john", "jack", "friend", 0), ("jack", "john", "friend", 0), ("john", "sarah", "child", 1), ("john", "jp", "child", 0), ("sarah", "john", "eContainer", None), ("jp", "john", "eContainer", None)]
    return Model(mm, spark.createDataFrame(objects, "id string, eclass string, name string, age long"), spark.createDataFrame(links, "src string, dst string, ref string, pos long"))


def ids(objects):
    return sorted(r["id"] for r in objects.to_df().collect())


def test_model_queries(family):
    find = family.find
    assert ids(find().from_instances_of("Person")) == ["jack", "jane", "john"]
    assert ids(find().from_all().is_instance_of("p::Being")) == ["jack", "jane", "john", "jp", "sarah"]
    assert ids(find().from_all().has("name", "John").e_get("friend")) == ["jack"]
    assert ids(find().from_objects("sarah").e_get_inverse("child")) == ["john"]
    assert ids(find().from_all().and_(lambda x: x.e_get("child"))) == ["john"]
    assert ids(find().from_objects("john").union(lambda x: x.e_get("child"), lambda x: x.e_get("married"))) == ["jane", "jp", "sarah"]
    assert ids(find().from_objects("john").closure("friend", "both")) == ["jack"]
    assert ids(find().from_objects("john").e_all_contents()) == ["jp", "sarah"]
    assert ids(find().from_all().has("nothing", 1)) == []
    assert [r["target"] for r in find().from_objects("john", "jane").e_get_ordered("child").collect()] == [None, "jp", "sarah"]
    assert [r["it"] for r in find().from_all().order_by("age").collect()] == ["jack", "sarah", "jp", "jane", "john"]
    ages = find().from_all().e_get("age")
    assert ages.sum_as_long().first()["result"] == 94 and ages.max_as_double().first()["result"] == 40.0
    assert ages.average().first()["result"] == 23.5
    assert find().from_all().e_get("name").as_number("long").count().first()["n"] == 0
    assert family.metamodel.package_by_uri("urn:p") == "p"
    with pytest.raises(KeyError):
        find().from_instances_of("Nobody")
    left = delete_cascade(family, family.objects.filter("id = 'john'").select("id"))
    assert sorted(r["id"] for r in left.objects.collect()) == ["jack", "jane"] and left.links.count() == 0


def test_xmi_round_trip(spark, tmp_path):
    objects = [("a", "Book", {"title": "A & \"B\""}), ("b", "Page", {"n": "1"}), ("c", "Page", {"n": "2"})]
    links = [("b", "a", "eContainer", None), ("a", "b", "pages", 0), ("c", "a", "eContainer", None), ("a", "c", "pages", 1), ("b", "c", "next", 0)]
    text = xmi.write_xmi(objects, links)
    got = xmi.parse(text)
    assert sorted(got[0], key=str) == sorted(objects, key=str) and sorted(got[1], key=str) == sorted(links, key=str)
    (tmp_path / "m.xmi").write_text(text)
    o, li = xmi.read_xmi(spark, f"file://{tmp_path}/*.xmi")
    assert {(r["id"], r["eclass"]) for r in o.collect()} == {(x[0], x[1]) for x in objects} and li.count() == 5


@pytest.fixture()
def log(spark):
    rows = [("master", "default", f"k{i % 5}", i, "D" if i % 7 == 0 else "P", i) for i in range(1, 30)] + [("dev", "other", "z", 40, "P", 1)]
    return VersionLog(spark.createDataFrame(rows, "branch string, keyspace string, key string, ts long, op string, v long"), BranchTree([Branch("master"), Branch("dev", "master", 20)]))


def test_dumps_and_backups(spark, log, tmp_path):
    want = sorted(log.snapshot("dev").collect())
    at = f"file://{tmp_path}"
    store_io.write_log(log, f"{at}/log")
    assert sorted(store_io.read_log(spark, f"{at}/log").snapshot("dev").collect()) == want
    store_io.write_dump(log, f"{at}/dump", compress=True, converters={"v": F.col("v").cast("string")})
    back = store_io.read_dump(spark, f"{at}/dump", {"v": F.col("v").cast("long")})
    assert sorted(back.snapshot("dev").collect()) == want and back.branches.get("dev").branching_ts == 20
    store_io.write_incremental(log, f"{at}/i0", 0, 10)
    store_io.write_incremental(log, f"{at}/i1", 10, 25)
    store_io.write_incremental(log, f"{at}/i2", 25)
    assert sorted(store_io.read_incremental(spark, [f"{at}/i{n}" for n in (2, 0, 1)]).snapshot("dev").collect()) == want
    with pytest.raises(ValueError, match="lack"):
        store_io.read_incremental(spark, [f"{at}/i0", f"{at}/i2"])


def test_graph_exchange(spark, tmp_path):
    g = make(spark, [("a", "r", "b<&>")])
    store_io.write_graph(g, f"file://{tmp_path}/g")
    back = store_io.read_graph(spark, f"file://{tmp_path}/g", like=g)
    assert sorted(back.edges.collect()) == sorted(g.edges.collect())
    store_io.write_graphml(g, f"file://{tmp_path}/ml")
    text = [r[0] for r in spark.read.text(f"file://{tmp_path}/ml/edges").collect()]
    assert text == ['<edge id="e0" source="a" target="b&lt;&amp;&gt;"><data key="label">r</data></edge>']


def test_streams(spark, log, tmp_path):
    at = f"file://{tmp_path}"
    log.rows.coalesce(1).write.parquet(f"{at}/in")
    changes = log_stream.read_changes(spark, f"{at}/in", log.rows.schema)
    log_stream.append_log(changes, f"{at}/out", f"{at}/cp").awaitTermination()
    log.rows.limit(0).unionByName(log.rows.filter("ts = 29").withColumn("ts", F.lit(99).cast("long"))).write.mode("append").parquet(f"{at}/in")
    log_stream.append_log(log_stream.read_changes(spark, f"{at}/in", log.rows.schema), f"{at}/out", f"{at}/cp").awaitTermination()
    got = spark.read.parquet(f"{at}/out")
    assert got.count() == log.rows.count() + 1
    q = log_stream.heads(log_stream.read_changes(spark, f"{at}/in", log.rows.schema), ["v"]).writeStream.outputMode("complete").format("memory").queryName("heads").start()
    q.processAllAvailable()
    q.stop()
    last = {r["key"]: r["ts"] for r in spark.sql("select * from heads where branch = 'master'").collect()}
    assert last == {"k0": 25, "k1": 26, "k2": 27, "k3": 28, "k4": 99}
    n = log_stream.commits_per_window(log.rows, "10 milliseconds").agg(F.sum("n")).first()[0]
    assert n == 30


def test_history_of_a_graph(spark, log):
    changes = gh.restore(log, "default", 12)
    restored = VersionLog(log.rows.unionByName(changes.withColumn("branch", F.lit("master")).withColumn("ts", F.lit(50).cast("long")).select(*log.rows.columns)), log.branches)
    now = {r["key"]: r["v"] for r in restored.snapshot(where=F.col("keyspace") == "default").collect()}
    then = {r["key"]: r["v"] for r in log.snapshot(ts=12, where=F.col("keyspace") == "default").collect()}
    assert now == then
    assert gh.branch_order(log.branches) == ["master", "dev"]
    at = gh.coordinates(log, ["master"], key="k1", keyspace="default", limit=2).collect()
    assert sorted(r["at"] for r in at) == [21, 26]
    prev = {(r["key"], r["at"]): r["previous_at"] for r in gh.changed_with_previous(log, "default", lo=20).collect()}
    assert prev["k1", 21] == 16 and prev["k1", 26] == 21
    vertices = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("e1", "P", "a", "b"), ("e2", "P", "a", "gone"), ("e3", "D", None, None)], "key string, op string, src string, dst string")
    ok, failed = gh.restorable_edges(edges, vertices)
    assert sorted(r["key"] for r in ok.collect()) == ["e1", "e3"] and [r["key"] for r in failed.collect()] == ["e2"]
