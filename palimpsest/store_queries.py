"""Queries that write and read back, run streams, or look at the whole of a store, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.compare import P
from .functions.period import FOREVER
from .functions.predicates import where
from .operators import graph_history as gh
from .operators import transactions as tx
from .operators.dateback import Dateback
from .operators.graph import Graph, add_edges, add_vertices, merge_edges, remove_edges, set_edge_property, set_property
from .operators.indexing import DirtyIndex, IndexManager, Query
from .operators.model import EClass, Feature, Metamodel, attach, delete_cascade
from .operators.versioned import ElementIndices, VersionedGraph, VersionedModel, merge_graphs
from .plans.branches import Branch, BranchTree
from .plans.checkpoints import shared_folder
from .plans.versions import VersionLog
from .queries import DAY, GRAPH, LOG, MODEL, PARTS, T0, T_DEV, T_READ, _parts, _snap, query
from .sources import derived as D
from .sources import store_io, xmi
from .sources.durable import DurableStore, StaleHead
from .streaming import log_stream

COLUMNS = ["branch", "keyspace", "key", "ts", "op", "event_type", "value"]
ROWS = f"WITH {LOG} SELECT branch, keyspace, key, ts, op, event_type, value FROM log"

GL = f"""gl AS (SELECT 'master' AS branch, 'vertex' AS keyspace, 'c' || c_custkey AS key, {T0} + c_custkey AS ts, 'P' AS op, 'customer' AS label,
  NULL::VARCHAR AS src, NULL::VARCHAR AS dst, c_name AS name, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'master', 'vertex', 'c' || c_custkey, {T0 + DAY} + c_custkey, 'P', 'customer', NULL, NULL, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'master', 'vertex', 'c' || c_custkey, {T0 + 2 * DAY} + c_custkey, 'D', NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 17 = 0
  UNION ALL SELECT 'dev', 'vertex', 'c' || c_custkey, {T_DEV + DAY} + c_custkey, 'P', 'customer', NULL, NULL, c_name, 0.0 FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'master', 'vertex', 'n' || n_nationkey, {T0}, 'P', 'nation', NULL, NULL, n_name, NULL FROM nation
  UNION ALL SELECT 'master', 'edge', 'e' || c_custkey, {T0 + 3 * DAY} + c_custkey, 'P', 'livesIn', 'c' || c_custkey, 'n' || c_nationkey, NULL, NULL FROM customer WHERE c_custkey % 17 <> 0
  UNION ALL SELECT 'master', 'edge', 'e' || c_custkey, {T0 + 4 * DAY} + c_custkey, 'D', NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 5 = 0
  UNION ALL SELECT 'master', 'variable', 'v' || n_nationkey, {T0}, 'P', NULL, NULL, NULL, n_name, NULL FROM nation WHERE n_nationkey < 2)"""


def _facts(spark, **facts) -> DataFrame:
    """What was seen, as rows ``fact, value``."""
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


def _facts_sql(**facts) -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in facts.items())
    return f"SELECT * FROM (VALUES {values}) AS t(fact, value)"


def _raises(error, f) -> bool:
    try:
        f()
    except error:
        return True
    return False


def _small(spark) -> tx.Store:
    rows = [("master", "default", "a", 10, "P", "x", 1.0), ("master", "default", "b", 20, "P", "y", 2.0)]
    schema = "branch string, keyspace string, key string, ts long, op string, event_type string, value double"
    return tx.Store(VersionLog(spark.createDataFrame(rows, schema), BranchTree([Branch("master")])))


# -- backends -------------------------------------------------------------------------------------


@query("store_cached", f"WITH {LOG}, {_snap('master', T_READ)} SELECT keyspace, key, ts, event_type, value FROM snap")
def _(spark, sf):
    store = tx.Store(D.event_log(spark, sf)).cached()
    return store.log.snapshot("master", T_READ).select("keyspace", "key", "ts", "event_type", "value")


@query("store_partitioned_files", f"WITH {LOG}, {_snap('dev', T_READ)} SELECT keyspace, key, ts, event_type, value FROM snap")
def _(spark, sf):
    at = shared_folder(spark)
    store_io.write_log(D.event_log(spark, sf), at)
    return store_io.read_log(spark, at).snapshot("dev", T_READ).select("keyspace", "key", "ts", "event_type", "value")


@query("store_durable_commits", f"""WITH {LOG}, {_snap('master', FOREVER)} SELECT keyspace, key, event_type, value FROM snap WHERE NOT (keyspace = 'default' AND key IN ('1', '2', '3'))
    UNION ALL SELECT 'default', '1', 'manual', 1.5 UNION ALL SELECT 'default', '3', 'later', 2.5""")
def _(spark, sf):
    at = shared_folder(spark)
    store = DurableStore.create(D.event_log(spark, sf), at)
    t = store.tx()
    t.put("1", ("manual", 1.5))
    t.remove("2")
    t.commit("first")
    t = DurableStore.open(spark, at).tx()
    t.put("3", ("later", 2.5))
    t.commit("second")
    again = DurableStore.open(spark, at)
    again.compact()
    return DurableStore.open(spark, at).log.snapshot().select("keyspace", "key", "event_type", "value")


@query("store_durable_stale_head", _facts_sql(stale="True", kept="['first']"))
def _(spark, sf):
    at = shared_folder(spark)
    one = DurableStore.create(_small(spark).log, at)
    two = DurableStore.open(spark, at)
    for store, metadata in ((one, "first"), (two, "second")):
        t = store.tx()
        t.put("a", (metadata, 3.0))
        if store is one:
            t.commit(metadata)
        else:
            stale = _raises(StaleHead, lambda t=t: t.commit("second"))
    return _facts(spark, stale=stale, kept=[m for _, _, m, _ in DurableStore.open(spark, at).commits])


# -- dumps and backups ----------------------------------------------------------------------------


@query("dump_full", ROWS)
def _(spark, sf):
    at = shared_folder(spark)
    store_io.write_dump(D.event_log(spark, sf), at, compress=True, aliases={"event_type": "kind"}, batch_size=10_000)
    return store_io.read_dump(spark, at).rows.select(*COLUMNS)


@query("dump_commits", f"WITH {LOG} SELECT branch, ts, CAST(count(*) AS VARCHAR) AS metadata FROM log GROUP BY branch, ts")
def _(spark, sf):
    log, at = D.event_log(spark, sf), shared_folder(spark)
    store_io.write_dump(log, at, commits=D.commit_rows(log))
    return store_io.read_whole_dump(spark, at).commits.select("branch", "ts", "metadata")


@query("dump_audit_and_indices", _facts_sql(operations="['purge_key']", indices="['type']", rows="1"))
def _(spark, sf):
    log, at = _small(spark).log, shared_folder(spark)
    d = Dateback(log)
    d.purge_key("b")
    idx = IndexManager(d.log)
    idx.create("type", "string", "event_type")
    store_io.write_dump(d.log, at, audit=d.audit_log(), indices=idx.list())
    dump = store_io.read_whole_dump(spark, at)
    done = [r["operation"] for r in dump.audit.collect()]
    return _facts(spark, operations=done, indices=[x["name"] for x in dump.indices], rows=dump.log.rows.count())


@query("dump_well_known_types", f"WITH {PARTS} SELECT key, words, brand, size, price FROM parts")
def _(spark, sf):
    at = shared_folder(spark)
    store_io.write_dump(D.part_log(spark, sf), at)
    return store_io.read_dump(spark, at).snapshot().select("key", "words", "brand", "size", "price")


@query("dump_converters", f"WITH {PARTS} SELECT key, words FROM parts")
def _(spark, sf):
    at = shared_folder(spark)
    store_io.write_dump(D.part_log(spark, sf), at, converters={"words": F.array_join("words", " ")})
    return store_io.read_dump(spark, at, converters={"words": F.split("words", " ")}).snapshot().select("key", "words")


@query("backup_incremental", ROWS)
def _(spark, sf):
    log, at = D.event_log(spark, sf), shared_folder(spark)
    ends = [0, T0 + 5 * DAY, T0 + 12 * DAY, FOREVER]
    for i, (since, until) in enumerate(zip(ends, ends[1:], strict=False)):
        store_io.write_incremental(log, f"{at}/{i}", since, until)
    return store_io.read_incremental(spark, [f"{at}/{i}" for i in (2, 0, 1)]).rows.select(*COLUMNS)


@query("backup_after_dateback", f"WITH {LOG} SELECT branch, keyspace, key, ts, op, event_type, value FROM log WHERE NOT (branch = 'master' AND keyspace = 'default' AND key = '8') UNION ALL SELECT 'master', 'default', 'injected', {T0 + 5}, 'P', 'late', 9.5")
def _(spark, sf):
    log, at = D.event_log(spark, sf), shared_folder(spark)
    store_io.write_incremental(log, f"{at}/0", 0, T_DEV)
    d = Dateback(log)
    late = [("default", "injected", T0 + 5, "P", "late", 9.5)]
    d.inject(spark.createDataFrame(late, "keyspace string, key string, ts long, op string, event_type string, value double"))
    d.purge_key("8")
    touched = [(branch, lo, hi) for _, branch, lo, hi, _ in d.operations()]
    store_io.write_incremental(d.log, f"{at}/1", T_DEV, FOREVER, touched)
    return store_io.read_incremental(spark, [f"{at}/0", f"{at}/1"]).rows.select(*COLUMNS)


@query("backup_gap", _facts_sql(gap="True"))
def _(spark, sf):
    log, at = _small(spark).log, shared_folder(spark)
    store_io.write_incremental(log, f"{at}/0", 0, 5)
    store_io.write_incremental(log, f"{at}/1", 15, 30)
    return _facts(spark, gap=_raises(ValueError, lambda: store_io.read_incremental(spark, [f"{at}/0", f"{at}/1"])))


# -- graph and model files ------------------------------------------------------------------------


@query("graph_dump", f"WITH {GRAPH} SELECT id, label, name, balance, words, size FROM v")
def _(spark, sf):
    g, at = D.graph(spark, sf), shared_folder(spark)
    store_io.write_graph(g, at)
    return store_io.read_graph(spark, at, like=g).vertices.select("id", "label", "name", "balance", "words", "size")


@query("graph_io_parquet", f"WITH {GRAPH} SELECT id, label, src, dst FROM e")
def _(spark, sf):
    at = shared_folder(spark)
    store_io.write_graph(D.graph(spark, sf), at, "parquet")
    return store_io.read_graph(spark, at, "parquet").edges.select("id", "label", "src", "dst")


@query("graph_io_graphml", f"WITH {GRAPH} SELECT id, label, name, balance, size FROM v")
def _(spark, sf):
    g, at = D.graph(spark, sf), shared_folder(spark)
    g = Graph(g.vertices.drop("words"), g.edges)
    store_io.write_graphml(g, at)
    return store_io.read_graphml(spark, at, like=g).vertices.select("id", "label", "name", "balance", "size")


@query("graph_io_graphml_edges", f"WITH {GRAPH} SELECT id, label, src, dst FROM e")
def _(spark, sf):
    g, at = D.graph(spark, sf), shared_folder(spark)
    g = Graph(g.vertices.drop("words"), g.edges)
    store_io.write_graphml(g, at)
    return store_io.read_graphml(spark, at, like=g).edges.select("id", "label", "src", "dst")


def _documents(spark, sf) -> str:
    """The regions with their nations as XMI, a file for each region, all ids but the nations' left out."""
    at = shared_folder(spark)
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    rows = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")
    ).collect()  # as many as there are regions
    files = []
    for row in rows:
        objects = [("r", "Region", {"name": row["r_name"]})]
        links = []
        for i, x in enumerate(row["nations"]):
            objects.append((f"n{x['n_nationkey']}", "Nation", {"name": x["n_name"]}))
            links += [(f"n{x['n_nationkey']}", "r", "eContainer", None), ("r", f"n{x['n_nationkey']}", "nations", i)]
        files.append((xmi.write_xmi(objects, links).replace(' xmi:id="r"', ""),))
    spark.createDataFrame(files, "value string").coalesce(1).write.option("maxRecordsPerFile", 1).text(at)
    return at


@query("xmi_objects", "SELECT 'Nation' AS eclass, n_name AS name FROM nation UNION ALL SELECT 'Region', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def _(spark, sf):
    objects, _ = xmi.read_xmi(spark, f"{_documents(spark, sf)}/*.txt")
    return objects.select("eclass", F.col("attrs")["name"].alias("name"))


@query("xmi_links", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    objects, links = xmi.read_xmi(spark, f"{_documents(spark, sf)}/*.txt")
    name = F.col("attrs")["name"]
    held = links.filter("ref = 'nations'")
    held = held.join(objects.select(F.col("id").alias("src"), name.alias("region")), "src")
    return held.join(objects.select(F.col("id").alias("dst"), name.alias("nation")), "dst").select("region", "nation")


# -- transactions ---------------------------------------------------------------------------------


@query("tx_incremental_commit", _facts_sql(before="2", after="3", timestamps="1", a="z"))
def _(spark, sf):
    store = _small(spark)
    t = store.tx()
    t.put("a", ("w", 5.0))
    first = t.commit_incremental()
    t.put("a", ("z", 6.0))
    t.put("c", ("q", 7.0))
    second = t.commit_incremental()
    before = store.log.snapshot().count()
    t.commit()
    rows = {r["key"]: r["event_type"] for r in store.log.snapshot().collect()}
    return _facts(spark, before=before, after=len(rows), timestamps=len({first, second}), a=rows["a"])


@query("tx_rollback", _facts_sql(rolled_back="-1", rows="2"))
def _(spark, sf):
    store = _small(spark)
    t = store.tx()
    t.put("a", ("w", 5.0))
    t.rollback()
    return _facts(spark, rolled_back=t.commit(), rows=store.log.rows.count())


@query("tx_metadata_filter", _facts_sql(rejected="True", accepted="True", rows="3"))
def _(spark, sf):
    store = _small(spark)
    store.metadata_filter = lambda branch, ts, metadata: metadata is not None
    t = store.tx()
    t.put("a", ("w", 5.0))
    rejected = _raises(ValueError, t.commit)
    accepted = t.commit("why") > 0
    return _facts(spark, rejected=rejected, accepted=accepted, rows=store.log.rows.count())


@query("store_read_only", _facts_sql(refused="True", rows="2"))
def _(spark, sf):
    store = _small(spark)
    store.read_only = True
    t = store.tx()
    t.put("a", ("w", 5.0))
    return _facts(spark, refused=_raises(PermissionError, t.commit), rows=store.log.rows.count())


@query("tx_triggers", _facts_sql(order="['high', 'low', 'after']", seen="{'current': 2.0, 'ancestor': 1.0, 'store': 1.0}", written="4.0", replaced="True", kept="False", cancelled="True"))
def _(spark, sf):
    store, order, seen, hooks = _small(spark), [], {}, gh.Triggers()

    def value(df):
        return df.filter("key = 'a'").first()["value"]

    def look(c):
        seen.update(current=value(c.current()), ancestor=value(c.ancestor()), store=value(c.store_state()))

    hooks.create("low", gh.PRE_COMMIT, lambda c: order.append("low"), 1)
    hooks.create("high", gh.PRE_COMMIT, lambda c: order.append("high"), 9)
    hooks.create("look", gh.PRE_PERSIST, look, 5)
    hooks.create("twice", gh.PRE_PERSIST, lambda c: c.changes.withColumn("value", F.col("value") * 2))
    hooks.create("after", gh.POST_COMMIT, lambda c: order.append("after"))
    replaced = hooks.create("after", gh.POST_COMMIT, lambda c: order.append("after"), overwrite=True)
    kept = hooks.create("after", gh.POST_COMMIT, lambda c: order.append("never"), if_absent=True)
    t = store.tx()
    t.put("a", ("w", 2.0))
    gh.commit_with_hooks(t, hooks)

    def stop(c):
        raise gh.CancelCommit("no")

    hooks.drop("look")
    hooks.create("stop", gh.PRE_PERSIST, stop)
    t = store.tx()
    t.put("a", ("w", 3.0))
    cancelled = _raises(gh.CancelCommit, lambda: gh.commit_with_hooks(t, hooks))
    return _facts(spark, order=order[:3], seen=seen, written=value(store.log.snapshot()), replaced=replaced, kept=kept, cancelled=cancelled).withColumn(
        "value", F.replace("value", F.lit('"'), F.lit("'"))
    )


# -- dateback -------------------------------------------------------------------------------------


@query("dateback_reads", f"WITH {LOG}, {_snap('master', T0 + 3 * DAY - 1)} SELECT keyspace, key, ts, event_type FROM snap")
def _(spark, sf):
    d = Dateback(D.event_log(spark, sf))
    d.purge_commits(T0 + 3 * DAY, T0 + 4 * DAY)
    return d.snapshot(T_READ).select("keyspace", "key", "ts", "event_type")


@query("dateback_log", "SELECT * FROM (VALUES ('purge_key', 'master', 0), ('transform_commit', 'master', 20), ('purge_commits', 'master', 20)) AS t(operation, branch, lo)")
def _(spark, sf):
    d = Dateback(_small(spark).log)
    d.purge_key("zz")
    d.transform_commit(20, lambda n, c: c)
    d.purge_commits(20)
    return d.audit_log().select("operation", "branch", F.col("lo").cast("int").alias("lo"))


@query("dateback_log_affecting", _facts_sql(at_15="['purge_key']", at_25="['purge_key', 'purge_commits']"))
def _(spark, sf):
    d = Dateback(_small(spark).log)
    d.purge_key("zz", lo=5, hi=9)
    d.purge_commits(20)
    return _facts(spark, **{f"at_{t}": [o[0] for o in d.operations(affecting=t)] for t in (15, 25)})


@query("dateback_dirty_indices", _facts_sql(dirty="True", refused="True", good="1"))
def _(spark, sf):
    log = _small(spark).log
    idx = IndexManager(log)
    idx.create("type", "string", "event_type", assume_no_prior_values=True)
    Dateback(log, indices=idx).purge_key("b")
    found = lambda: Query(idx).where(where("type").starts_with("x")).count()
    dirty, refused = bool(idx.dirty()), _raises(DirtyIndex, found)
    idx.reindex_all()
    return _facts(spark, dirty=dirty, refused=refused, good=found().first()["n"])


# -- indices --------------------------------------------------------------------------------------


@query("index_type_guards", _facts_sql(string_on_long="True", long_on_string="True", unknown="True", dirty="True"))
def _(spark, sf):
    idx = _parts(spark, sf)
    run = lambda c: (lambda: Query(idx).where(c).count())
    facts = {
        "string_on_long": _raises(Exception, run(where("size").contains("1"))),
        "long_on_string": _raises(Exception, run(where("brand").is_greater_than(1))),
        "unknown": _raises(Exception, run(where("nothing").contains("1"))),
    }
    idx.create("late", "string", "brand")
    return _facts(spark, **facts, dirty=_raises(DirtyIndex, run(where("late").contains("1"))))


@query("index_build_and_period", f"WITH {LOG}, {_snap('master', T_READ)} SELECT key FROM snap WHERE keyspace = 'default' AND event_type = 'view'")
def _(spark, sf):
    idx = IndexManager(D.event_log(spark, sf))
    idx.create("type", "string", lambda: F.lower("event_type"), valid_from=T0, valid_to=FOREVER)
    idx.reindex_all()
    return Query(idx, "master", T_READ).where(where("type").is_equal_to("view")).get_keys()


@query("index_management", _facts_sql(listed="['brand', 'price', 'size', 'words']", dirty="4", good="0", ended="False", deleted="['brand', 'price', 'size']", cleared="[]"))
def _(spark, sf):
    idx = _parts(spark, sf)
    names = lambda: sorted(x.name for x in idx.list())
    listed = names()
    idx.mark_all_dirty()
    dirty = len(idx.dirty())
    idx.reindex_all()
    good = len(idx.dirty())
    idx.set_end("price", T0)
    ended = "price" in idx.find("master", T0 + 1)
    idx.delete("words")
    deleted = names()
    idx.clear()
    return _facts(spark, listed=listed, dirty=dirty, good=good, ended=ended, deleted=deleted, cleared=names())


@query("index_inheritance", f"WITH {LOG}, {_snap('exp', T_READ)} SELECT key FROM snap WHERE keyspace = 'default' AND upper(event_type) = 'VIEW'")
def _(spark, sf):
    idx = IndexManager(D.event_log(spark, sf))
    idx.create("type", "string", "event_type", assume_no_prior_values=True)
    # the branch's own index hides the one that it inherits
    idx.create("type", "string", lambda: F.upper("event_type"), branch="dev", assume_no_prior_values=True)
    return Query(idx, "exp", T_READ).where(where("type").is_equal_to("VIEW")).get_keys()


def _element_indices(spark, sf) -> ElementIndices:
    idx = ElementIndices(D.graph_log(spark, sf))
    idx.builder().string_index().on_vertex_property("name").assume_no_prior_values().build()
    idx.builder().double_index().on_vertex_property("balance").valid(T0).assume_no_prior_values().build()
    idx.builder().string_index().on_edge_property("dst").build()
    return idx


@query("graph_index_query", f"WITH {GL}, {_snap('dev', T_READ, log='gl')} SELECT key FROM snap WHERE keyspace = 'vertex' AND balance > 1000 AND contains(name, '5')")
def _(spark, sf):
    q = Query(_element_indices(spark, sf), "dev", T_READ).in_keyspace("vertex")
    return q.where(where("vertex.balance").is_greater_than(1000.0) & where("vertex.name").contains("5")).get_keys()


@query("graph_index_builder", _facts_sql(vertex="['balance', 'name']", edge="[]", reindexed="['dst']", dropped="['balance']", untyped="True"))
def _(spark, sf):
    idx = _element_indices(spark, sf)
    vertex, edge = idx.indexed("vertex"), idx.indexed("edge")
    idx.reindex_all()
    reindexed = idx.indexed("edge")
    idx.drop("vertex", "name")
    untyped = _raises(ValueError, lambda: idx.builder().on_vertex_property("x").build())
    return _facts(spark, vertex=vertex, edge=edge, reindexed=reindexed, dropped=idx.indexed("vertex"), untyped=untyped)


@query("graph_index_values", f"WITH {GL}, {_snap('master', T_READ, log='gl')} SELECT key, balance AS value FROM snap WHERE keyspace = 'vertex' AND balance IS NOT NULL")
def _(spark, sf):
    return _element_indices(spark, sf).values("vertex", "balance", ts=T_READ)


@query("model_attribute_index", f"WITH {GL}, {_snap('master', T_READ, log='gl')} SELECT key FROM snap WHERE keyspace = 'vertex' AND starts_with(name, 'NATION_1')")
def _(spark, sf):
    idx = ElementIndices(D.object_log(spark, sf))
    idx.builder().string_index().on_attribute("name").build()
    if idx.indexed("object") != []:
        raise AssertionError("an index is dirty until it is built")
    idx.reindex_all()
    return Query(idx, "master", T_READ).in_keyspace("object").where(where("object.name").starts_with("NATION_1")).get_keys()


# -- graphs and models over time ------------------------------------------------------------------


def _vg(spark, sf) -> VersionedGraph:
    return VersionedGraph(D.graph_log(spark, sf), ["label", "name", "balance"], ["label"])


@query("vgraph_vertices_at", f"WITH {GL}, {_snap('dev', T_READ, log='gl')} SELECT key AS id, label, name, balance FROM snap WHERE keyspace = 'vertex'")
def _(spark, sf):
    return _vg(spark, sf).at("dev", T_READ).V().element_map().withColumnRenamed("it", "id")


@query("vgraph_traversal_at", f"WITH {GL}, {_snap('master', T0 + 4 * DAY, log='gl')} SELECT n.name, count(*) AS n FROM snap e JOIN snap c ON c.key = e.src JOIN snap n ON n.key = e.dst WHERE e.keyspace = 'edge' AND c.balance > 0 GROUP BY n.name")
def _(spark, sf):
    t = _vg(spark, sf).at("master", T0 + 4 * DAY).V().has("balance", P.gt(0.0)).out("livesIn").group_count("name")
    return t.select(F.col("group").alias("name"), "n")


@query("vertex_history", f"WITH {GL} SELECT ts FROM gl WHERE branch IN ('master', 'dev') AND keyspace = 'vertex' AND key = 'c12'")
def _(spark, sf):
    return _vg(spark, sf).history("vertex", "c12", "dev")


@query("edge_history", f"WITH {GL} SELECT ts FROM gl WHERE keyspace = 'edge' AND key = 'e5'")
def _(spark, sf):
    return _vg(spark, sf).history("edge", "e5")


@query("vertex_last_modification", f"WITH {GL} SELECT 'c' || c_custkey AS key, coalesce((SELECT max(ts) FROM gl WHERE gl.key = 'c' || c_custkey AND branch = 'master' AND ts <= {T0 + DAY + 50}), -1) AS last_modified FROM customer")
def _(spark, sf):
    ids = D.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"))
    return _vg(spark, sf).last_modification("vertex", ids, ts=T0 + DAY + 50)


@query("vertex_modifications", f"WITH {GL} SELECT key, ts FROM gl WHERE branch = 'master' AND keyspace = 'vertex' AND ts BETWEEN {T0 + 10} AND {T0 + DAY + 40}")
def _(spark, sf):
    return _vg(spark, sf).modifications("vertex", T0 + 10, T0 + DAY + 40)


@query("edge_modifications", f"WITH {GL} SELECT key, ts FROM gl WHERE keyspace = 'edge' AND ts BETWEEN {T0 + 3 * DAY} AND {T0 + 4 * DAY + 20}")
def _(spark, sf):
    return _vg(spark, sf).modifications("edge", T0 + 3 * DAY, T0 + 4 * DAY + 20)


@query("changed_elements_at_commit", f"WITH {GL} SELECT keyspace AS kind, key FROM gl WHERE branch = 'master' AND ts IN ({T0}, {T0 + 3 * DAY + 4})")
def _(spark, sf):
    g, out = _vg(spark, sf), None
    for kind in ("vertex", "edge", "variable"):
        for ts in (T0, T0 + 3 * DAY + 4):
            part = g.changed_at(kind, ts).select(F.lit(kind).alias("kind"), "key")
            out = part if out is None else out.unionByName(part)
    return out


@query("graph_variables", f"WITH {GL} SELECT key, name FROM gl WHERE keyspace = 'variable'")
def _(spark, sf):
    return _vg(spark, sf).variables().select("key", "name")


@query("iterate_coordinates", f"WITH {GL}, c AS (SELECT DISTINCT branch, ts FROM gl WHERE ts > {T0 + DAY} AND ts % 2 = 0) SELECT branch, CASE branch WHEN 'master' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END AS place, ts AS \"at\" FROM c QUALIFY row_number() OVER (PARTITION BY branch ORDER BY ts DESC) <= 20")
def _(spark, sf):
    return _vg(spark, sf).iterate().after(T0 + DAY).where(lambda at: at % 2 == 0).latest(20).coordinates()


@query("iterate_history_of_vertex", f"WITH {GL} SELECT branch, ts AS \"at\" FROM gl WHERE key = 'c12'")
def _(spark, sf):
    return _vg(spark, sf).iterate().history_of("vertex", "c12").coordinates().select("branch", "at")


_AT = f"c AS (SELECT DISTINCT branch, ts AS \"at\" FROM gl WHERE branch = 'master' ORDER BY ts DESC LIMIT 3)"


@query("iterate_all_elements", f"""WITH {GL}, {_AT}, s AS (SELECT c."at", gl.*, row_number() OVER (PARTITION BY c."at", keyspace, key ORDER BY gl.ts DESC) AS rn
    FROM c JOIN gl ON gl.branch = 'master' AND gl.ts <= c."at") SELECT branch, "at", keyspace AS kind, key AS id FROM s WHERE rn = 1 AND op = 'P' AND keyspace <> 'variable'""")
def _(spark, sf):
    return _vg(spark, sf).iterate(["master"]).latest(3).elements()


@query("iterate_changed_elements", f"""WITH {GL} SELECT DISTINCT branch, ts AS "at", keyspace AS kind, key AS id FROM gl WHERE ts < {T0 + 2 * DAY} AND keyspace <> 'variable'""")
def _(spark, sf):
    return _vg(spark, sf).iterate().before(T0 + 2 * DAY).changed()


@query("iterate_changed_neighbours", f"""WITH {GL}, c AS (SELECT DISTINCT key, ts AS "at" FROM gl WHERE branch = 'dev' AND keyspace = 'vertex'), {_snap('master', FOREVER, log='gl')}
    SELECT c.key, c."at", e.dst AS neighbour FROM c JOIN snap e ON e.keyspace = 'edge' AND e.src = c.key""")
def _(spark, sf):
    return _vg(spark, sf).iterate(["dev"]).changed_with_neighbours("dev")


def _vm(spark, sf) -> VersionedModel:
    return VersionedModel(D.metamodel(), D.object_log(spark, sf), ["name", "balance"])


@query("model_at", f"WITH {GL}, {_snap('dev', T_READ, log='gl')} SELECT c.key AS id, n.name FROM snap c JOIN snap e ON e.src = c.key JOIN snap n ON n.key = e.dst WHERE c.label = 'customer'")
def _(spark, sf):
    t = _vm(spark, sf).at("dev", T_READ).find().from_instances_of("Customer").named("c").e_get("livesIn").e_get("name")
    return t.t.rows.select(F.col("c").alias("id"), F.col("it").alias("name"))


@query("model_object_history", f"WITH {GL} SELECT ts FROM gl WHERE branch IN ('master', 'dev') AND key = 'c24'")
def _(spark, sf):
    return _vm(spark, sf).history("c24", "dev")


@query("model_object_modifications", f"WITH {GL} SELECT key, ts FROM gl WHERE branch = 'master' AND keyspace = 'vertex' AND ts BETWEEN {T0 + DAY} AND {T0 + 3 * DAY}")
def _(spark, sf):
    return _vm(spark, sf).modifications(T0 + DAY, T0 + 3 * DAY)


@query("model_attach_delete_commit", f"""WITH {GL}, {_snap('master', FOREVER, log='gl')} SELECT 'object' AS kind, key AS name FROM snap WHERE keyspace = 'vertex' AND key <> 'n1'
    UNION ALL SELECT 'object', 'x1' UNION ALL SELECT 'link', src || '>' || dst FROM snap WHERE keyspace = 'edge' AND dst <> 'n1' UNION ALL SELECT 'link', 'c1>x1'""")
def _(spark, sf):
    vm = _vm(spark, sf)
    m = delete_cascade(vm.at(), spark.createDataFrame([("n1",)], "id string"))
    new = spark.createDataFrame([("x1", "Nation", "X")], "id string, eclass string, name string")
    m = attach(m, new, spark.createDataFrame([("c1", "x1", "livesIn", None)], "src string, dst string, ref string, pos long"))
    store = tx.Store(vm.log)
    t = store.tx()
    t.put_all(vm.changes(m))
    t.commit("one nation less, one more")
    after = VersionedModel(vm.metamodel, store.log, vm.attributes).at()
    objects = after.objects.select(F.lit("object").alias("kind"), F.col("id").alias("name"))
    return objects.unionByName(after.links.select(F.lit("link").alias("kind"), F.concat("src", F.lit(">"), "dst").alias("name")))


def _edited(g: Graph) -> Graph:
    """Balances of every third customer raised, every seventh customer gone, one vertex and one edge new."""
    n = F.col("id").substr(2, 20).cast("long")
    customers = g.vertices.filter("label = 'customer'")
    g = set_property(g, customers.filter(n % 3 == 0).select("id"), "balance", F.col("balance") + 10)
    g = Graph(g.vertices.filter(~((F.col("label") == "customer") & (n % 7 == 0))), g.edges)
    spark = g.vertices.sparkSession
    g = add_vertices(g, spark.createDataFrame([("x1", "nation", "X")], "id string, label string, name string"))
    return add_edges(g, spark.createDataFrame([("e-x", "livesIn", "c1", "x1")], "id string, label string, src string, dst string"))


_MERGED = f"""{_snap('master', T0 + DAY, name='a', log='gl')}, {_snap('master', T_READ, name='h', log='gl')},
    mv AS (SELECT h.key AS id, h.label, h.name, CASE WHEN a.key IS NOT NULL AND a.label = 'customer' AND CAST(h.key[2:] AS BIGINT) % 3 = 0 THEN a.balance + 10 ELSE h.balance END AS balance
      FROM h LEFT JOIN a ON a.key = h.key WHERE h.keyspace = 'vertex' AND NOT (a.key IS NOT NULL AND h.label = 'customer' AND CAST(h.key[2:] AS BIGINT) % 7 = 0)
      UNION ALL SELECT 'x1', 'nation', 'X', NULL)"""


@query("graph_merge_vertices", f"WITH {GL}, {_MERGED} SELECT id, label, name, balance FROM mv")
def _(spark, sf):
    g = _vg(spark, sf)
    before = g.at("master", T0 + DAY)
    return merge_graphs(before, _edited(before), g.at("master", T_READ)).vertices.select("id", "label", "name", "balance")


@query("graph_merge_edges", f"""WITH {GL}, {_MERGED} SELECT key AS id, label, src, dst FROM h WHERE keyspace = 'edge' AND src IN (SELECT id FROM mv) AND dst IN (SELECT id FROM mv)
    UNION ALL SELECT 'e-x', 'livesIn', 'c1', 'x1'""")
def _(spark, sf):
    g = _vg(spark, sf)
    before = g.at("master", T0 + DAY)
    return merge_graphs(before, _edited(before), g.at("master", T_READ)).edges.select("id", "label", "src", "dst")


@query("graph_lifecycle", f"""WITH {GL}, {_snap('master', T0 + 3 * DAY, name='a', log='gl')}, {_snap('dev', T_READ, name='b', log='gl')},
    ends AS (SELECT src, dst FROM b WHERE keyspace = 'edge' EXCEPT ALL SELECT src, dst FROM a WHERE keyspace = 'edge'),
    s AS (SELECT coalesce(a.keyspace, b.keyspace) AS kind, coalesce(a.key, b.key) AS id, CASE WHEN a.key IS NULL THEN 'NEW' WHEN b.key IS NULL THEN 'REMOVED'
      WHEN a.balance IS DISTINCT FROM b.balance THEN 'PROPERTY_CHANGED' ELSE 'PERSISTED' END AS status FROM a FULL JOIN b ON a.keyspace = b.keyspace AND a.key = b.key
      WHERE coalesce(a.keyspace, b.keyspace) <> 'variable')
    SELECT kind, id, CASE WHEN status = 'PERSISTED' AND kind = 'vertex' AND id IN (SELECT src FROM ends UNION SELECT dst FROM ends) THEN 'EDGE_CHANGED' ELSE status END AS status FROM s
    UNION ALL SELECT 'vertex', 'made and removed', 'OBSOLETE'""")
def _(spark, sf):
    g = _vg(spark, sf)
    touched = spark.createDataFrame([("vertex", "made and removed"), ("vertex", "n1")], "kind string, id string")
    return gh.lifecycle(g.at("master", T0 + 3 * DAY), g.at("dev", T_READ), touched)


# -- graph steps ----------------------------------------------------------------------------------


def _g(name: str, sql: str):
    return query(f"graph_{name}", f"WITH {GRAPH} {sql}")


@_g("lambda_filter", "SELECT id FROM v WHERE label = 'nation' AND CAST(id[2:] AS BIGINT) % 2 = 0")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").filter(lambda it: it.substr(2, 9).cast("long") % 2 == 0)
    return t.rows.select(F.col("it").alias("id"))


@_g("plain_values_as_predicates", "SELECT id FROM v WHERE size = 7 OR name = 'NATION_3'")
def _(spark, sf):
    g = D.graph(spark, sf)
    return g.V().has("size", 7).rows.unionByName(g.V().has("name", P.eq("NATION_3")).rows).select(F.col("it").alias("id"))


@_g("full_scan_hook", "SELECT * FROM (VALUES ('vertex'), ('edge')) AS t(kind)")
def _(spark, sf):
    told: list[str] = []
    g = D.graph(spark, sf)
    g = Graph(g.vertices, g.edges, on_full_scan=told.append)
    g.V().has_label("nation")
    g.V("n1")
    g.E()
    return spark.createDataFrame([(k,) for k in told], "kind string")


@_g("order_with", "SELECT id FROM v WHERE label = 'region' ORDER BY length(id), id DESC LIMIT 3")
def _(spark, sf):
    return D.graph(spark, sf).V().has_label("region").order_with(lambda it: -it.substr(2, 9).cast("long")).limit(3).select(F.col("it").alias("id"))


@_g("limit", "SELECT 4 AS n")
def _(spark, sf):
    return D.graph(spark, sf).V().has_label("nation").limit(4).count()


@_g("range_skip_tail", "SELECT 'range' AS step, id FROM (SELECT id FROM v WHERE label = 'nation' ORDER BY id OFFSET 3 LIMIT 4) UNION ALL SELECT 'skip', id FROM (SELECT id FROM v WHERE label = 'nation' ORDER BY id OFFSET 20) UNION ALL SELECT 'tail', id FROM (SELECT id FROM v WHERE label = 'nation' ORDER BY id DESC LIMIT 3)")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation")
    out = None
    for name, part in (("range", t.range_(3, 7)), ("skip", t.skip(20)), ("tail", t.tail(3))):
        rows = part.rows.select(F.lit(name).alias("step"), F.col("it").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_g("unfold", "SELECT unnest(words) AS word FROM v WHERE label = 'part'")
def _(spark, sf):
    lists = D.graph(spark, sf).V().has_label("part").value_map("words")
    return D.graph(spark, sf).inject(lists, "words").unfold().rows.select(F.col("it").alias("word"))


@_g("store_cap", "SELECT id FROM v WHERE label = 'nation' UNION ALL SELECT DISTINCT dst FROM e WHERE label = 'partOf'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").store("seen").out("partOf").dedup().store("seen")
    return t.cap("seen").rows.select(F.col("it").alias("id"))


@_g("path", "SELECT c.src || '>' || c.dst || '>' || n.dst AS path FROM e c JOIN e n ON n.src = c.dst WHERE c.label = 'basedIn' AND n.label = 'partOf'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("supplier").with_path().out("basedIn").out("partOf")
    return t.path().select(F.array_join("path", ">").alias("path"))


@_g("cyclic_path", "SELECT a.src || '>' || a.dst || '>' || b.src AS path FROM e a JOIN e b ON a.dst = b.dst AND a.label = b.label WHERE a.label = 'partOf' AND a.src = b.src")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").with_path().out("partOf").in_("partOf").cyclic_path()
    return t.path().select(F.array_join("path", ">").alias("path"))


@_g("tree", "SELECT dst AS path, count(*) AS n FROM e WHERE label = 'partOf' GROUP BY dst UNION ALL SELECT dst || '>' || src, 1 FROM e WHERE label = 'partOf'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("region").with_path().in_("partOf").tree()
    return t.select(F.array_join("path", ">").alias("path"), "n")


@_g("side_effect_local", "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM e WHERE label = 'livesIn') WHERE rn <= 2")
def _(spark, sf):
    calls: list = []
    t = D.graph(spark, sf).V().has_label("nation").side_effect(calls.append).local(lambda x: x).as_("n").local_limit(lambda x: x.in_("livesIn"), 2)
    return t.rows.select(F.col("it").alias("src"), F.col("n").alias("dst")) if len(calls) == 1 else t.rows


@_g("match", "SELECT c.src AS c, c.dst AS n, r.dst AS r FROM e c JOIN e r ON r.src = c.dst WHERE c.label = 'livesIn' AND r.label = 'partOf'")
def _(spark, sf):
    return D.graph(spark, sf).V().has_label("customer").match(("c", lambda x: x.out("livesIn"), "n"), ("n", lambda x: x.out("partOf"), "r"))


@_g("sack", "SELECT s.id, 1.0 + s.balance AS sack FROM v s WHERE s.label = 'supplier'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("supplier").with_sack(F.lit(1.0)).sack(lambda a, b: a + b, "balance")
    return t.rows.select(F.col("it").alias("id"), "sack")


@_g("merge_edges", "SELECT id, label, src, dst FROM e WHERE label = 'partOf' UNION ALL SELECT 'new', 'partOf', 'n1', 'r9' WHERE EXISTS (SELECT 1 FROM v WHERE id = 'r4')")
def _(spark, sf):
    g = D.graph(spark, sf)
    g = add_vertices(g, spark.createDataFrame([("r9", "region")], "id string, label string"))
    have = g.edges.filter("id = 'o1'").select(F.lit("again").alias("id"), "label", "src", "dst")
    new = spark.createDataFrame([("new", "partOf", "n1", "r9")], "id string, label string, src string, dst string")
    return merge_edges(g, have.unionByName(new)).edges.filter("label = 'partOf'").select("id", "label", "src", "dst")


@_g("edge_property_and_drop", "SELECT id, CASE WHEN CAST(id[2:] AS BIGINT) % 2 = 0 THEN 'even' END AS kind FROM e WHERE label = 'partOf' AND id <> 'o3'")
def _(spark, sf):
    g = D.graph(spark, sf)
    g = Graph(g.vertices, g.edges.withColumn("kind", F.lit(None).cast("string")))
    own = g.edges.filter("label = 'partOf'")
    g = set_edge_property(g, own.filter(F.col("id").substr(2, 9).cast("long") % 2 == 0).select("id"), "kind", F.lit("even"))
    g = remove_edges(g, own.filter("id = 'o3'").select("id"))
    return g.edges.filter("label = 'partOf'").select("id", "kind")


@_g("write_checks", _facts_sql(vertex="True", edge="True", end="True").replace("SELECT *", "SELECT fact, value"))
def _(spark, sf):
    g = D.graph(spark, sf)
    e = "id string, label string, src string, dst string"

    def read(rows: DataFrame) -> None:
        """Every row is made, none comes to the driver."""
        rows.select("id").write.format("noop").mode("overwrite").save()

    tries = {
        "vertex": lambda: read(add_vertices(g, spark.createDataFrame([("n1", "nation")], "id string, label string")).vertices),
        "edge": lambda: read(add_edges(g, spark.createDataFrame([("o1", "partOf", "n1", "r1")], e)).edges),
        "end": lambda: read(add_edges(g, spark.createDataFrame([("q", "partOf", "n1", "nowhere")], e)).edges),
    }
    return _facts(spark, **{k: _raises(Exception, f) for k, f in tries.items()})


# -- model steps ----------------------------------------------------------------------------------


def _m(name: str, sql: str):
    return query(f"model_{name}", f"WITH {MODEL} {sql}")


@_m("not_null_and_filter", "SELECT id FROM o WHERE eclass = 'Customer' AND balance > 100")
def _(spark, sf):
    q = D.model(spark, sf).find().from_instances_of("Customer").not_null().filter(lambda c: c > 100, "balance")
    return q.to_df()


@_m("as_typed", "SELECT 'object' AS kind, id AS value FROM o WHERE id IN ('n1', 'n2') UNION ALL SELECT 'character', id[1] FROM o WHERE eclass = 'Region' UNION ALL SELECT 'boolean', CAST(balance > 0 AS VARCHAR) FROM o WHERE eclass = 'Supplier'")
def _(spark, sf):
    m = D.model(spark, sf)
    names = spark.createDataFrame([("n1",), ("n2",), ("nobody",)], "x string")
    objects = m.find().from_rows(names.withColumnRenamed("x", "id")).as_e_object().to_df("value")
    letters = m.find().from_instances_of("Region").map(lambda c: c.substr(1, 1)).as_character().to_df("value")
    flags = m.find().from_instances_of("Supplier").e_get("balance").map(lambda c: c > 0).as_boolean().to_df("value")
    out = objects.select(F.lit("object").alias("kind"), "value").unionByName(letters.select(F.lit("character").alias("kind"), "value"))
    return out.unionByName(flags.select(F.lit("boolean").alias("kind"), F.col("value").cast("string").alias("value")))


@_m("identity_and_reify", "SELECT id FROM o WHERE eclass = 'Region'")
def _(spark, sf):
    m = D.model(spark, sf)
    ids = m.find().from_instances_of("Region").map(lambda c: c).to_set()
    return m.find().from_rows(ids).as_e_object().to_set()


@query("package_registry", _facts_sql(packages="['a', 'shop']", by_uri="shop", updated="['Place2']", kept_uri="shop", unknown="True", left="['a']"))
def _(spark, sf):
    mm = Metamodel()
    mm.register(EClass("Thing", "shop", (), (Feature("name", "attribute"),)), EClass("Old", "shop"), uri="urn:shop")
    mm.register(EClass("B", "a"), uri="urn:a")
    packages, by_uri = mm.packages(), mm.package_by_uri("urn:shop")
    mm.update(EClass("Place2", "shop"))
    updated = sorted(c.name for c in mm.classes.values() if c.package == "shop")
    kept = mm.package_by_uri("urn:shop")
    unknown = _raises(KeyError, lambda: mm.update(EClass("X", "none")))
    mm.delete_package("shop")
    return _facts(spark, packages=packages, by_uri=by_uri, updated=updated, kept_uri=kept, unknown=unknown, left=mm.packages())


# -- streams --------------------------------------------------------------------------------------


def _streamed(spark, sf) -> tuple[DataFrame, DataFrame, str]:
    """The event log written as files, a stream over them, and a folder."""
    log, at = D.event_log(spark, sf), shared_folder(spark)
    log.rows.repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    return log_stream.read_changes(spark, f"{at}/in", log.rows.schema, max_files=2), log.rows, at


@query("stream_append", ROWS)
def _(spark, sf):
    changes, rows, at = _streamed(spark, sf)
    log_stream.append_log(changes, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select(*COLUMNS)


def _table_of(stream: DataFrame, spark, at: str) -> DataFrame:
    """What a stream in complete mode has at its end: each batch writes its result, the last one stays."""
    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch{n}")
        spark.createDataFrame([(n,)], "n long").write.mode("append").parquet(f"{at}/batches")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{at}/batches").agg(F.max("n")).first()[0]
    return spark.read.parquet(f"{at}/batch{last}")


@query("stream_heads_running", f"""WITH {LOG} SELECT branch, keyspace, key, ts, op FROM log
    QUALIFY row_number() OVER (PARTITION BY branch, keyspace, key ORDER BY ts DESC) = 1""")
def _(spark, sf):
    changes, _, at = _streamed(spark, sf)
    return _table_of(log_stream.heads(changes, ["event_type", "value"]), spark, at).select("branch", "keyspace", "key", "ts", "op")


@query("stream_windows_late", f"WITH {LOG} SELECT branch, ts // 3600000 * 3600000 AS window_start, count(*) AS n FROM log GROUP BY ALL")
def _(spark, sf):
    changes, _, at = _streamed(spark, sf)
    return _table_of(log_stream.all_commits_per_window(changes), spark, at)
