"""Versioned inputs derived from plain tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.model import EClass, Feature, Metamodel, Model
from ..plans.branches import Branch, BranchTree
from ..plans.pieces import dealt, pieces
from ..plans.versions import VersionLog

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01
T_DEV, T_EXP, T_READ = T0 + 10 * DAY, T0 + 15 * DAY, T0 + 25 * DAY
_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def branch_tree() -> BranchTree:
    return BranchTree([Branch("master"), Branch("dev", "master", T_DEV), Branch("exp", "dev", T_EXP)])


def event_log(spark: SparkSession, sf_dir: str) -> VersionLog:
    """Events as a log: a user's events are versions of its key, errors remove it."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.expr(_MS))
    n = F.col("event_id") % 10
    e = e.withColumn("branch", F.when(n < 7, "master").when(n < 9, "dev").otherwise("exp"))
    e = e.filter((F.col("branch") == "master") | ((F.col("branch") == "dev") & (F.col("ts") > T_DEV)) | ((F.col("branch") == "exp") & (F.col("ts") > T_EXP)))
    removed = F.col("event_type") == "error"
    e = e.select(
        "branch", F.when(F.col("user_id") % 5 == 0, "vip").otherwise("default").alias("keyspace"),
        F.col("user_id").cast("string").alias("key"), "ts", F.when(removed, "D").otherwise("P").alias("op"),
        F.when(~removed, F.col("event_type")).alias("event_type"), F.when(~removed, F.col("value")).alias("value"), "event_id",
    )
    last = e.groupBy("branch", "keyspace", "key", "ts").agg(F.max_by(F.struct("op", "event_type", "value"), "event_id").alias("v"))
    return VersionLog(last.select("branch", "keyspace", "key", "ts", "v.op", "v.event_type", "v.value"), branch_tree())


def commit_rows(log: VersionLog) -> DataFrame:
    """A commit for each timestamp of a branch; every seventh millisecond is internal."""
    c = log.rows.groupBy("branch", "ts").agg(F.count(F.lit(1)).cast("string").alias("metadata"))
    return c.withColumn("internal", F.col("ts") % 7 == 0).select("branch", "ts", "metadata", "internal")


def part_log(spark: SparkSession, sf_dir: str) -> VersionLog:
    """Parts as a log: some have a second version, some are removed, some lack a size or a brand."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.select(
        F.lit("master").alias("branch"), F.lit("default").alias("keyspace"), k.cast("string").alias("key"), k.alias("n"),
        F.split("p_name", " ").alias("words"), F.when(k % 13 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 11 != 0, F.col("p_size").cast("long")).alias("size"), F.col("p_retailprice").alias("price"),
    )
    first = base.withColumn("ts", k_ts("n", 0)).withColumn("op", F.lit("P"))
    second = base.filter("n % 4 = 0").withColumn("ts", k_ts("n", DAY)).withColumn("op", F.lit("P")).withColumn("size", F.col("size") + 1)
    gone = base.filter("n % 17 = 0").withColumn("ts", k_ts("n", 2 * DAY)).withColumn("op", F.lit("D"))
    gone = gone.withColumns({c: F.lit(None).cast(gone.schema[c].dataType) for c in ("words", "brand", "size", "price")})
    rows = first.unionByName(second).unionByName(gone).drop("n")
    return VersionLog(rows.select("branch", "keyspace", "key", "ts", "op", "words", "brand", "size", "price"))


def k_ts(n: str, plus: int):
    return (F.lit(T0 + plus) + F.col(n)).cast("long")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, suppliers, nations, regions and parts with what joins them."""
    def vertices(source, prefix, key, label, **props):
        t = table(spark, sf_dir, source)
        cols = {
            "name": F.lit(None).cast("string"), "balance": F.lit(None).cast("double"),
            "words": F.lit(None).cast("array<string>"), "size": F.lit(None).cast("long"),
        } | {k: (F.col(v) if isinstance(v, str) else v) for k, v in props.items()}
        return t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), *[c.alias(n) for n, c in cols.items()])

    v = vertices("customer", "c", "c_custkey", "customer", name="c_name", balance="c_acctbal")
    v = v.unionByName(vertices("supplier", "s", "s_suppkey", "supplier", name="s_name", balance="s_acctbal"))
    v = v.unionByName(vertices("nation", "n", "n_nationkey", "nation", name="n_name"))
    v = v.unionByName(vertices("region", "r", "r_regionkey", "region", name="r_name"))
    v = v.unionByName(vertices("part", "p", "p_partkey", "part", name="p_name", words=F.split("p_name", " "), size=F.col("p_size").cast("long")))

    def edges(t, label, eid, src, dst):
        return t.select(eid.alias("id"), F.lit(label).alias("label"), src.alias("src"), dst.alias("dst"))

    def ident(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))

    e = edges(table(spark, sf_dir, "customer"), "livesIn", ident("l", "c_custkey"), ident("c", "c_custkey"), ident("n", "c_nationkey"))
    e = e.unionByName(edges(table(spark, sf_dir, "supplier"), "basedIn", ident("b", "s_suppkey"), ident("s", "s_suppkey"), ident("n", "s_nationkey")))
    e = e.unionByName(edges(table(spark, sf_dir, "nation"), "partOf", ident("o", "n_nationkey"), ident("n", "n_nationkey"), ident("r", "n_regionkey")))
    p = table(spark, sf_dir, "part").filter("p_partkey > 0")
    e = e.unionByName(edges(p, "half", ident("h", "p_partkey"), ident("p", "p_partkey"), ident("p", F.floor(F.col("p_partkey") / 2))))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = pieces(li, o)
    li, o = dealt(li, n, "l_orderkey"), dealt(o, n, "o_orderkey")
    b = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.min("o_custkey").alias("c"), F.min("l_partkey").alias("p"))
    eid = F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return Graph(v, e.unionByName(edges(b, "bought", eid, ident("c", "c"), ident("p", "p"))))


GRAPH_PAYLOAD = ["label", "src", "dst", "name", "balance"]


def graph_log(spark: SparkSession, sf_dir: str) -> VersionLog:
    """Customers and nations with the edges between them as a log: customers change, some go, so do some edges."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")

    def rows(df, branch, keyspace, key, ts, op="P", **payload):
        cols = {"label": none, "src": none, "dst": none, "name": none, "balance": F.lit(None).cast("double")} | payload
        return df.select(
            F.lit(branch).alias("branch"), F.lit(keyspace).alias("keyspace"), key.alias("key"), ts.cast("long").alias("ts"),
            F.lit(op).alias("op"), *[v.alias(n) for n, v in cols.items()],
        )

    def ident(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    own = {"label": F.lit("customer"), "name": F.col("c_name")}
    out = rows(c, "master", "vertex", ident("c", "c_custkey"), F.lit(T0) + k, balance=F.col("c_acctbal"), **own)
    n = table(spark, sf_dir, "nation")
    for part in (
        rows(c.filter(k % 4 == 0), "master", "vertex", ident("c", "c_custkey"), F.lit(T0 + DAY) + k, balance=F.col("c_acctbal") + 1, **own),
        rows(c.filter(k % 17 == 0), "master", "vertex", ident("c", "c_custkey"), F.lit(T0 + 2 * DAY) + k, "D"),
        rows(c.filter(k % 6 == 0), "dev", "vertex", ident("c", "c_custkey"), F.lit(T_DEV + DAY) + k, balance=F.lit(0.0), **own),
        rows(n, "master", "vertex", ident("n", "n_nationkey"), F.lit(T0), label=F.lit("nation"), name=F.col("n_name")),
        rows(c.filter(k % 17 != 0), "master", "edge", ident("e", "c_custkey"), F.lit(T0 + 3 * DAY) + k, label=F.lit("livesIn"),
             src=ident("c", "c_custkey"), dst=ident("n", "c_nationkey")),
        rows(c.filter("c_custkey % 17 <> 0 and c_custkey % 5 = 0"), "master", "edge", ident("e", "c_custkey"), F.lit(T0 + 4 * DAY) + k, "D"),
        rows(n.filter("n_nationkey < 2"), "master", "variable", ident("v", "n_nationkey"), F.lit(T0), name=F.col("n_name")),
    ):
        out = out.unionByName(part)
    return VersionLog(out, branch_tree())


def object_log(spark: SparkSession, sf_dir: str) -> VersionLog:
    """The customers and nations of ``graph_log`` as objects, and its edges as links."""
    g = graph_log(spark, sf_dir)
    r = g.rows.filter("keyspace <> 'variable'")
    vertex = F.col("keyspace") == "vertex"
    rows = r.select(
        "branch", F.when(vertex, "object").otherwise("link").alias("keyspace"), "key", "ts", "op", F.initcap(F.when(vertex, F.col("label"))).alias("eclass"),
        "name", "balance", "src", "dst", F.when(~vertex, F.col("label")).alias("ref"), F.lit(None).cast("long").alias("pos"),
    )
    return VersionLog(rows, g.branches)


def metamodel() -> Metamodel:
    mm = Metamodel()
    name = Feature("name", "attribute")
    mm.register(
        EClass("Thing", "shop", (), (name,)),
        EClass("Party", "shop", ("Thing",), (Feature("balance", "attribute"),)),
        EClass("Customer", "shop", ("Party",), (Feature("livesIn", "reference"),)),
        EClass("Supplier", "shop", ("Party",), (Feature("basedIn", "reference"),)),
        EClass("Place", "shop", ("Thing",), ()),
        EClass("Nation", "shop", ("Place",), ()),
        EClass("Region", "shop", ("Place",), (Feature("nations", "reference", True, True, True),)),
        uri="urn:shop",
    )
    return mm


def model(spark: SparkSession, sf_dir: str) -> Model:
    """Customers and suppliers in nations, contained in regions."""
    g = graph(spark, sf_dir)
    o = g.vertices.filter("label <> 'part'").select("id", F.initcap("label").alias("eclass"), "name", "balance")
    e = g.edges.filter("label in ('livesIn', 'basedIn', 'partOf')")
    none = F.lit(None).cast("long")
    refs = e.filter("label <> 'partOf'").select("src", "dst", F.col("label").alias("ref"), none.alias("pos"))
    held = e.filter("label in ('livesIn', 'partOf')").select("src", "dst", F.lit("eContainer").alias("ref"), none.alias("pos"))
    down = e.filter("label = 'partOf'").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("nations").alias("ref"), F.expr("cast(substring(src, 2) as bigint)").alias("pos")
    )
    return Model(metamodel(), o, refs.unionByName(held).unionByName(down))
