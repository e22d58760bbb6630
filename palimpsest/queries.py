"""Queries over the driver's tables, one or more for each operator, with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import numbers
from .functions.compare import P
from .functions.period import FOREVER, Period
from .functions.predicates import where
from .operators import graph_history as gh
from .operators import transactions as tx
from .operators.commitlog import CommitLog
from .operators.dateback import Dateback
from .operators.graph import remove_vertices, set_property, subgraph
from .operators.indexing import IndexManager, Query, SortKey
from .operators.model import Model, delete_cascade, evolve
from .plans.checkpoints import cut_lineage
from .plans.versions import VersionLog
from .sources import derived as D
from .streaming.log_stream import commits_per_window, heads

T0, T_DEV, T_EXP, T_READ, DAY = D.T0, D.T_DEV, D.T_EXP, D.T_READ, D.DAY

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        _Q[name] = f
        if sql is not None:
            _S[name] = sql
        return f

    return add


# -- SQL of the derived inputs --------------------------------------------------------------------

LOG = f"""
ev AS (SELECT CASE WHEN event_id % 10 < 7 THEN 'master' WHEN event_id % 10 < 9 THEN 'dev' ELSE 'exp' END AS branch,
  CASE WHEN user_id % 5 = 0 THEN 'vip' ELSE 'default' END AS keyspace, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ts,
  CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
  CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value, event_id FROM events),
log AS (SELECT branch, keyspace, key, ts, op, event_type, value FROM ev
  WHERE branch = 'master' OR (branch = 'dev' AND ts > {T_DEV}) OR (branch = 'exp' AND ts > {T_EXP})
  QUALIFY row_number() OVER (PARTITION BY branch, keyspace, key, ts ORDER BY event_id DESC) = 1)"""


def _seen(branch: str, ts: int) -> str:
    """The rows that a read sees, spelt out for the three branches."""
    rows = {
        "master": [("master", ts)],
        "dev": [("dev", ts), ("master", min(ts, T_DEV))],
        "exp": [("exp", ts), ("dev", min(ts, T_EXP)), ("master", min(ts, T_DEV))],
    }[branch]
    parts = [f"SELECT *, {i} AS depth FROM log WHERE branch = '{b}' AND ts <= {hi}" for i, (b, hi) in enumerate(rows)]
    return " UNION ALL ".join(parts)


def _snap(branch: str, ts: int, name: str = "snap", also: str = "op = 'P'", log: str = "log") -> str:
    seen = _seen(branch, ts).replace("FROM log ", f"FROM {log} ")
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyspace, key ORDER BY depth, ts DESC) AS rn"
        f" FROM ({seen})) WHERE rn = 1 AND {also})"
    )


def _valid(branch: str, name: str = "valid") -> str:
    return (
        f"{name} AS (SELECT *, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY keyspace, key ORDER BY ts, depth DESC),"
        f" {FOREVER}) AS valid_to FROM ({_seen(branch, FOREVER)}))"
    )


# -- reads ----------------------------------------------------------------------------------------


@query("kv_snapshot_where_eq", f"WITH {LOG}, {_snap('master', T_READ)} SELECT key, ts, value FROM snap WHERE keyspace = 'default' AND event_type = 'purchase'")
def _(spark, sf):
    log = D.event_log(spark, sf)
    idx = IndexManager(log)
    idx.create("type", "string", "event_type", assume_no_prior_values=True)
    return Query(idx, "master", T_READ).where(where("type").is_equal_to("purchase")).rows().select("key", "ts", "value")


@query("kv_get", f"WITH {LOG}, {_snap('master', T_READ)} SELECT key, ts, event_type, value FROM snap WHERE keyspace = 'default' AND key = '8'")
def _(spark, sf):
    return D.event_log(spark, sf).get("8", ts=T_READ).select("key", "ts", "event_type", "value")


@query("kv_get_binary", f"WITH {LOG}, {_snap('master', T_READ)} SELECT key, hex(encode(event_type)) AS bytes FROM snap WHERE keyspace = 'default' AND key IN ('1', '2', '3', '4')")
def _(spark, sf):
    log = D.event_log(spark, sf)
    rows = None
    for k in ("1", "2", "3", "4"):
        one = log.get_binary("event_type", k, ts=T_READ)
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("key", F.hex("bytes").alias("bytes"))


@query("kv_exists", f"WITH {LOG}, {_snap('dev', T_READ)} SELECT k.key, s.key IS NOT NULL AS \"exists\" FROM (SELECT DISTINCT key FROM log) k LEFT JOIN (SELECT * FROM snap WHERE keyspace = 'default') s ON k.key = s.key")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return log.exists(log.rows.select("key").distinct(), branch="dev", ts=T_READ)


@query("kv_keyset", f"WITH {LOG}, {_snap('master', T_READ)} SELECT key FROM snap WHERE keyspace = 'vip'")
def _(spark, sf):
    return D.event_log(spark, sf).key_set("vip", ts=T_READ)


@query("kv_keyspaces", f"WITH {LOG} SELECT keyspace, min(ts) AS since FROM ({_seen('exp', T_READ)}) GROUP BY keyspace")
def _(spark, sf):
    return D.event_log(spark, sf).keyspaces("exp", T_READ)


@query("kv_entries", f"WITH {LOG} SELECT branch, keyspace, key, ts, op FROM log WHERE ts BETWEEN {T0 + DAY} AND {T0 + 20 * DAY}")
def _(spark, sf):
    return D.event_log(spark, sf).entries(T0 + DAY, T0 + 20 * DAY).select("branch", "keyspace", "key", "ts", "op")


@query(
    "kv_ranged_get",
    f"""WITH {LOG}, {_valid('exp')}, k AS (SELECT DISTINCT key FROM log UNION SELECT 'never'),
    own AS (SELECT * FROM valid WHERE keyspace = 'default'),
    now AS (SELECT * FROM own WHERE valid_from <= {T_READ} AND valid_to > {T_READ}),
    f AS (SELECT key, min(ts) AS first FROM own GROUP BY key)
    SELECT k.key, CASE WHEN n.op = 'P' THEN n.event_type END AS event_type, CASE WHEN n.op = 'P' THEN n.value END AS value,
      coalesce(n.valid_from, 0) AS valid_from, coalesce(n.valid_to, f.first, {FOREVER}) AS valid_to
    FROM k LEFT JOIN now n ON k.key = n.key LEFT JOIN f ON k.key = f.key""",
)
def _(spark, sf):
    log = D.event_log(spark, sf)
    keys = log.rows.select("key").unionByName(spark.createDataFrame([("never",)], "key string")).distinct()
    return log.ranged_get(keys, branch="exp", ts=T_READ)


@query("kv_validity", f"WITH {LOG}, {_valid('exp')} SELECT keyspace, key, op, event_type, value, branch, valid_from, valid_to FROM valid")
def _(spark, sf):
    return D.event_log(spark, sf).validity("exp")


@query(
    "kv_asof_join",
    f"""WITH {LOG}, {_valid('dev')}, c AS (SELECT DISTINCT 'default' AS keyspace, key, {T0} + (CAST(key AS BIGINT) % 29) * {DAY} AS "at" FROM log)
    SELECT c.keyspace, c.key, c."at", v.event_type, v.value, v.valid_from, v.valid_to FROM c JOIN valid v
    ON c.keyspace = v.keyspace AND c.key = v.key AND c."at" >= v.valid_from AND c."at" < v.valid_to WHERE v.op = 'P'""",
)
def _(spark, sf):
    log = D.event_log(spark, sf)
    at = (F.lit(T0) + (F.col("key").cast("long") % 29) * DAY).alias("at")
    return log.at_coordinates(log.rows.select("key").distinct().select(F.lit("default").alias("keyspace"), "key", at), "dev")


@query("kv_period_algebra", f"""WITH {LOG}, {_valid('master')}, q AS (SELECT {T0 + 5 * DAY} AS a, {T0 + 9 * DAY} AS b)
    SELECT key, valid_from, valid_to, valid_from < b AND a < valid_to AS overlaps, valid_from <= a AND valid_to >= b AS contains,
      valid_from = b OR valid_to = a AS adjacent, valid_from < a AS before, valid_to <= a AS strictly_before, valid_from >= b AS strictly_after,
      valid_to = {FOREVER} AS open_ended,
      CASE WHEN valid_from < b AND a < valid_to THEN least(valid_to, b) - greatest(valid_from, a) ELSE 0 END AS common
    FROM valid, q WHERE keyspace = 'vip'""")
def _(spark, sf):
    v = D.event_log(spark, sf).validity("master", where=F.col("keyspace") == "vip")
    p, q = Period(F.col("valid_from"), F.col("valid_to")), Period.of(T0 + 5 * DAY, T0 + 9 * DAY)
    return v.select(
        "key", "valid_from", "valid_to", p.overlaps(q).alias("overlaps"), p.contains(q).alias("contains"), p.adjacent_to(q).alias("adjacent"),
        p.before(q).alias("before"), p.strictly_before(q).alias("strictly_before"), p.strictly_after(q).alias("strictly_after"),
        p.is_open_ended().alias("open_ended"), p.intersection(q).length().alias("common"),
    )


# -- branches and history -------------------------------------------------------------------------

for _b in ("master", "dev", "exp"):

    @query(f"branch_snapshot_{_b}", f"WITH {LOG}, {_snap(_b, T_READ)} SELECT keyspace, key, ts, branch, event_type, value FROM snap")
    def _(spark, sf, b=_b):
        return D.event_log(spark, sf).snapshot(b, T_READ)


@query("branch_isolation", f"WITH {LOG}, {_snap('dev', T_DEV - 1)} SELECT keyspace, key, ts, branch FROM snap")
def _(spark, sf):
    return D.event_log(spark, sf).snapshot("dev", T_DEV - 1).select("keyspace", "key", "ts", "branch")


@query("branch_tree", f"""WITH RECURSIVE b(name, origin, branching_ts) AS (VALUES ('master', NULL, 0), ('dev', 'master', {T_DEV}), ('exp', 'dev', {T_EXP})),
    r AS (SELECT name AS root, name FROM b UNION ALL SELECT r.root, b.name FROM r JOIN b ON b.origin = r.name)
    SELECT root, name AS child FROM r WHERE root <> name""")
def _(spark, sf):
    t = D.branch_tree()
    rows = [(b, c) for b in t.names() for c in t.children(b, True)]
    return spark.createDataFrame(rows, "root string, child string")


_HIST = f"SELECT DISTINCT ts FROM ({_seen('exp', T_READ)}) WHERE keyspace = 'default' AND key = '8'"


@query("kv_history_desc", f"WITH {LOG} {_HIST}")
def _(spark, sf):
    return D.event_log(spark, sf).history("8", branch="exp", ts=T_READ)


@query("kv_history_bounds", f"WITH {LOG} {_HIST} AND ts BETWEEN {T0 + 5 * DAY} AND {T0 + 20 * DAY}")
def _(spark, sf):
    return D.event_log(spark, sf).history("8", branch="exp", ts=T_READ, lo=T0 + 5 * DAY, hi=T0 + 20 * DAY, ascending=True)


@query("branch_history_concat", f"""WITH {LOG} SELECT keyspace, key, count(*) AS versions, min(ts) AS first_ts, max(ts) AS last_ts
    FROM ({_seen('exp', FOREVER)}) GROUP BY keyspace, key""")
def _(spark, sf):
    seen = D.event_log(spark, sf).seen("exp")
    return seen.groupBy("keyspace", "key").agg(F.count(F.lit(1)).alias("versions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("kv_last_modification", f"""WITH {LOG}, {_snap('exp', T_READ, also='1 = 1')}, k AS (SELECT DISTINCT key FROM log UNION SELECT 'never')
    SELECT k.key, coalesce(s.ts, -1) AS last_modified FROM k LEFT JOIN (SELECT * FROM snap WHERE keyspace = 'default') s ON k.key = s.key""")
def _(spark, sf):
    log = D.event_log(spark, sf)
    keys = log.rows.select("key").unionByName(spark.createDataFrame([("never",)], "key string")).distinct()
    return log.last_modification(keys, branch="exp", ts=T_READ)


@query("kv_modifications", f"WITH {LOG} SELECT DISTINCT keyspace, key, ts FROM ({_seen('dev', T0 + 12 * DAY)}) WHERE keyspace = 'default' AND ts >= {T0 + 8 * DAY}")
def _(spark, sf):
    return D.event_log(spark, sf).modifications(T0 + 8 * DAY, T0 + 12 * DAY, branch="dev")


@query("kv_changed_keys_at", f"WITH {LOG} SELECT DISTINCT keyspace, key FROM log WHERE branch = 'master' AND ts = (SELECT min(ts) FROM log)")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return log.changed_keys_at(log.rows.agg(F.min("ts")).first()[0], branch="exp")


@query("stats_head_history", f"""WITH {LOG}, {_snap('master', FOREVER)}, t AS (SELECT count(*) AS total FROM log WHERE branch = 'master'),
    h AS (SELECT count(*) AS head FROM snap) SELECT head, total, head / total AS ratio FROM h, t""")
def _(spark, sf):
    return D.event_log(spark, sf).head_statistics()


@query("stats_branches", f"""WITH {LOG} SELECT branch, count(*) AS cells, count(DISTINCT keyspace || '/' || key) AS keys,
    count(*) FILTER (op = 'D') AS tombstones, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY branch""")
def _(spark, sf):
    return D.event_log(spark, sf).branch_statistics()


@query("rollover", f"WITH {LOG}, {_snap('master', T_READ)} SELECT keyspace, key, event_type, value FROM snap")
def _(spark, sf):
    rolled = D.event_log(spark, sf).rollover(T_READ)
    late = VersionLog(rolled.rows.filter(F.col("ts") >= T_READ), rolled.branches)
    return late.snapshot("master", T_READ).select("keyspace", "key", "event_type", "value")


# -- commits --------------------------------------------------------------------------------------

COMMITS = f"{LOG}, commits AS (SELECT branch, ts, CAST(count(*) AS VARCHAR) AS metadata, ts % 7 = 0 AS internal FROM log GROUP BY branch, ts)"
OWN = "FROM commits WHERE branch = 'master' AND NOT internal"


def _commits(spark, sf) -> CommitLog:
    log = D.event_log(spark, sf)
    return CommitLog(D.commit_rows(log), log.branches)


@query("commits_between", f"WITH {COMMITS} SELECT ts, metadata {OWN} AND ts BETWEEN {T0 + DAY} AND {T0 + 3 * DAY}")
def _(spark, sf):
    return _commits(spark, sf).between(T0 + DAY, T0 + 3 * DAY)


@query("commits_between_internal", f"WITH {COMMITS} SELECT ts, metadata FROM commits WHERE branch = 'dev' AND ts BETWEEN {T_DEV} AND {T_READ}")
def _(spark, sf):
    return _commits(spark, sf).between(T_DEV, T_READ, "dev", internal=True)


@query("commits_paged", f"WITH {COMMITS} SELECT ts, metadata {OWN} AND ts BETWEEN {T0} AND {T_READ} ORDER BY ts LIMIT 20 OFFSET 60")
def _(spark, sf):
    return _commits(spark, sf).paged(T0, T_READ, 20, 3, ascending=True)


@query("commits_before", f"WITH {COMMITS} SELECT ts, metadata {OWN} AND ts < {T0 + 7 * DAY} ORDER BY ts DESC LIMIT 10")
def _(spark, sf):
    return _commits(spark, sf).before(T0 + 7 * DAY, 10)


@query("commits_after", f"WITH {COMMITS} SELECT ts, metadata {OWN} AND ts > {T0 + 7 * DAY} ORDER BY ts LIMIT 10")
def _(spark, sf):
    return _commits(spark, sf).after(T0 + 7 * DAY, 10)


@query("commits_around", f"""WITH {COMMITS}, lo AS (SELECT ts, metadata {OWN} AND ts < {T0 + 7 * DAY} ORDER BY ts DESC LIMIT 5),
    hi AS (SELECT ts, metadata {OWN} AND ts >= {T0 + 7 * DAY} ORDER BY ts LIMIT 6) SELECT * FROM lo UNION ALL SELECT * FROM hi""")
def _(spark, sf):
    return _commits(spark, sf).around(T0 + 7 * DAY, 11)


@query("commits_around_short", f"WITH {COMMITS} SELECT ts, metadata {OWN} ORDER BY ts LIMIT 9")
def _(spark, sf):
    return _commits(spark, sf).around(T0, 9)


@query("commits_count", f"WITH {COMMITS} SELECT count(*) AS n {OWN}")
def _(spark, sf):
    return _commits(spark, sf).count()


@query("commits_count_between", f"WITH {COMMITS} SELECT count(*) AS n {OWN} AND ts BETWEEN {T0 + DAY} AND {T0 + 9 * DAY}")
def _(spark, sf):
    return _commits(spark, sf).count_between(T0 + DAY, T0 + 9 * DAY)


@query("commit_metadata_at", f"WITH {COMMITS} SELECT ts, metadata FROM commits WHERE branch = 'master' AND ts = (SELECT max(ts) FROM commits WHERE branch = 'master' AND ts < {T_DEV})")
def _(spark, sf):
    c = _commits(spark, sf)
    ts = c.rows.filter((F.col("branch") == "master") & (F.col("ts") < T_DEV)).agg(F.max("ts")).first()[0]
    return c.metadata_at(ts, "exp")


@query("stream_window_counts", f"""WITH {LOG} SELECT branch, ts // 3600000 * 3600000 AS window_start, count(*) AS n FROM log GROUP BY ALL""")
def _(spark, sf):
    return commits_per_window(D.event_log(spark, sf).rows, "1 hour")


@query("stream_heads", f"""WITH {LOG} SELECT branch, keyspace, key, ts, op FROM log
    QUALIFY row_number() OVER (PARTITION BY branch, keyspace, key ORDER BY ts DESC) = 1""")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return heads(log.rows, log.payload).select("branch", "keyspace", "key", "ts", "op")


# -- predicates -----------------------------------------------------------------------------------

PARTS = f"""base AS (SELECT 'master' AS branch, 'default' AS keyspace, CAST(p_partkey AS VARCHAR) AS key, p_partkey AS n,
  string_split(p_name, ' ') AS words, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS size, p_retailprice AS price FROM part),
parts AS (SELECT key, words, brand, CASE WHEN n % 4 = 0 THEN size + 1 ELSE size END AS size, price FROM base WHERE n % 17 <> 0)"""


def _parts(spark, sf) -> IndexManager:
    idx = IndexManager(D.part_log(spark, sf))
    for name, kind in (("words", "string"), ("brand", "string"), ("size", "long"), ("price", "double")):
        idx.create(name, kind, name, assume_no_prior_values=True)
    return idx


def _any(test: str) -> str:
    return f"len(list_filter(words, lambda w: {test})) > 0"


def _none(test: str) -> str:
    return f"len(list_filter(words, lambda w: {test})) = 0"


_w, _b, _s, _p = where("words"), where("brand"), where("size"), where("price")
PREDICATES = {
    "contains": (_w.contains("in"), _any("contains(w, 'in')")),
    "contains_ci": (_w.contains_ignore_case("IN"), _any("contains(lower(w), 'in')")),
    "not_contains": (_w.not_contains("in"), _none("contains(w, 'in')")),
    "not_contains_ci": (_b.not_contains_ignore_case("brand#1"), "NOT coalesce(contains(lower(brand), 'brand#1'), false)"),
    "starts_with": (_w.starts_with("b"), _any("starts_with(w, 'b')")),
    "starts_with_ci": (_b.starts_with_ignore_case("BRAND#2"), "starts_with(lower(brand), 'brand#2')"),
    "not_starts_with": (_w.not_starts_with("b"), _none("starts_with(w, 'b')")),
    "not_starts_with_ci": (_b.not_starts_with_ignore_case("BRAND#2"), "NOT coalesce(starts_with(lower(brand), 'brand#2'), false)"),
    "ends_with": (_w.ends_with("g"), _any("ends_with(w, 'g')")),
    "ends_with_ci": (_w.ends_with_ignore_case("G"), _any("ends_with(lower(w), 'g')")),
    "not_ends_with": (_w.not_ends_with("g"), _none("ends_with(w, 'g')")),
    "not_ends_with_ci": (_w.not_ends_with_ignore_case("G"), _none("ends_with(lower(w), 'g')")),
    "regex": (_b.matches_regex("Brand#[12]."), "coalesce(regexp_full_match(brand, 'Brand#[12].'), false)"),
    "regex_ci": (_b.matches_regex_ignore_case("brand#[12]."), "coalesce(regexp_full_match(brand, '(?i)brand#[12].'), false)"),
    "not_regex": (_b.not_matches_regex("Brand#[12]."), "NOT coalesce(regexp_full_match(brand, 'Brand#[12].'), false)"),
    "not_regex_ci": (_b.not_matches_regex_ignore_case("brand#[12]."), "NOT coalesce(regexp_full_match(brand, '(?i)brand#[12].'), false)"),
    "eq": (_b.is_equal_to("Brand#7"), "brand = 'Brand#7'"),
    "eq_ci": (_b.is_equal_to_ignore_case("BRAND#7"), "lower(brand) = 'brand#7'"),
    "not_eq": (_b.is_not_equal_to("Brand#7"), "NOT coalesce(brand = 'Brand#7', false)"),
    "not_eq_ci": (_b.is_not_equal_to_ignore_case("BRAND#7"), "NOT coalesce(lower(brand) = 'brand#7', false)"),
    "long_eq": (_s.is_equal_to(7), "size = 7"),
    "long_not_eq": (_s.is_not_equal_to(7), "NOT coalesce(size = 7, false)"),
    "long_gt": (_s.is_greater_than(40), "size > 40"),
    "long_ge": (_s.is_greater_than_or_equal_to(40), "size >= 40"),
    "long_lt": (_s.is_less_than(5), "size < 5"),
    "long_le": (_s.is_less_than_or_equal_to(5), "size <= 5"),
    "not_long_gt": (~_s.is_greater_than(40), "size <= 40"),
    "double_eq_tol": (_p.is_equal_to(910.0, 0.55), "price - 0.55 <= 910.0 AND 910.0 <= price + 0.55"),
    "double_not_eq_tol": (_p.is_not_equal_to(910.0, 0.55), "NOT (price - 0.55 <= 910.0 AND 910.0 <= price + 0.55)"),
    "double_gt": (_p.is_greater_than(960.0), "price > 960"),
    "double_ge": (_p.is_greater_than_or_equal_to(960.0), "price >= 960"),
    "double_lt": (_p.is_less_than(950.0), "price < 950"),
    "double_le": (_p.is_less_than_or_equal_to(950.0), "price <= 950"),
    "in_strings": (_w.in_strings({"ring", "bolt"}), _any("w IN ('ring', 'bolt')")),
    "in_strings_ci": (_w.in_strings_ignore_case({"RING", "Bolt"}), _any("lower(w) IN ('ring', 'bolt')")),
    "not_in_strings": (_b.not_in_strings({"Brand#1", "Brand#2"}), "NOT coalesce(brand IN ('Brand#1', 'Brand#2'), false)"),
    "not_in_strings_ci": (_b.not_in_strings_ignore_case({"BRAND#1"}), "NOT coalesce(lower(brand) = 'brand#1', false)"),
    "in_longs": (_s.in_longs({1, 2, 3}), "size IN (1, 2, 3)"),
    "not_in_longs": (_s.not_in_longs({1, 2, 3}), "NOT coalesce(size IN (1, 2, 3), false)"),
    "double_within_tol": (_p.in_doubles({905.0, 950.0}, 0.25), "abs(price - 905.0) <= 0.25 OR abs(price - 950.0) <= 0.25"),
    "double_not_within_tol": (_p.not_in_doubles({905.0, 950.0}, 0.25), "NOT (abs(price - 905.0) <= 0.25 OR abs(price - 950.0) <= 0.25)"),
    "in_empty_set": (_b.in_strings(()), "false"),
    "not_in_empty_set": (_b.not_in_strings(()), "true"),
    "and_or_not": (~(_w.contains("in") & _s.is_greater_than(20)) | _b.is_equal_to("Brand#3"), f"({_none(chr(99) + 'ontains(w, ' + chr(39) + 'in' + chr(39) + ')')}) OR size <= 20 OR brand = 'Brand#3'"),
    "or_of_not_eq": (_b.is_not_equal_to("Brand#1") | _b.is_not_equal_to("Brand#2"), "true"),
}
for _name, (_cond, _sql) in PREDICATES.items():

    @query(f"pred_{_name}", f"WITH {PARTS} SELECT key FROM parts WHERE {_sql}")
    def _(spark, sf, cond=_cond):
        return Query(_parts(spark, sf)).where(cond).get_keys()


@query("query_count", f"WITH {PARTS} SELECT count(*) AS n FROM parts WHERE size > 10")
def _(spark, sf):
    return Query(_parts(spark, sf)).where(_s.is_greater_than(10)).count()


@query("query_values_as_set", f"WITH {LOG}, {_snap('master', T_READ)} SELECT DISTINCT event_type FROM snap WHERE keyspace = 'default' AND value > 50")
def _(spark, sf):
    idx = IndexManager(D.event_log(spark, sf))
    idx.create("value", "double", "value", assume_no_prior_values=True)
    return Query(idx, ts=T_READ).where(where("value").is_greater_than(50.0)).get_values().select("event_type").distinct()


@query("query_qualified_result", f"WITH {PARTS} SELECT 'default' AS keyspace, key, brand, size, price FROM parts WHERE brand = 'Brand#7'")
def _(spark, sf):
    return Query(_parts(spark, sf)).where(_b.is_equal_to("Brand#7")).get_qualified_result().drop("words")


@query("index_contents", f"WITH {PARTS} SELECT value, list_sort(list(DISTINCT key)) AS keys FROM (SELECT key, unnest(words) AS value FROM parts) GROUP BY value")
def _(spark, sf):
    return _parts(spark, sf).contents("words")


@query("index_values_by_key", f"WITH {PARTS} SELECT key, list_sort(list(DISTINCT value)) AS \"values\" FROM (SELECT key, unnest(words) AS value FROM parts) GROUP BY key")
def _(spark, sf):
    return _parts(spark, sf).values_by_key("words")


def _placed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every row of an ordered result with its place: the rows of the partitions before, and those in its own."""
    at = cut_lineage(df.select(*columns, F.monotonically_increasing_id().alias("__at")))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.join(F.broadcast(before), "__part").select(place.alias("place"), *columns)


@query("sort_multi_nulls_last", f"""WITH {PARTS} SELECT row_number() OVER (ORDER BY brand DESC NULLS LAST, size ASC NULLS LAST, key) AS place, key, brand, size
    FROM parts""")
def _(spark, sf):
    q = Query(_parts(spark, sf)).sort_by(SortKey("brand", descending=True), SortKey("size"))
    return _placed(q.rows(), ["key", "brand", "size"])


@query("sort_nulls_first_multivalue", f"""WITH {PARTS} SELECT row_number() OVER (ORDER BY size NULLS FIRST, list_max(words) DESC NULLS LAST, key) AS place, key
    FROM parts""")
def _(spark, sf):
    q = Query(_parts(spark, sf)).sort_by(SortKey("size", nulls_first=True), SortKey("words", descending=True, ignore_case=True))
    return _placed(q.rows(), ["key"])


# -- writes ---------------------------------------------------------------------------------------

CHANGES = f"""changes AS (SELECT keyspace, key, CASE WHEN CAST(key AS BIGINT) % 7 = 0 THEN 'D' ELSE 'P' END AS op,
  CASE WHEN CAST(key AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(key AS BIGINT) % 3 = 0 THEN event_type ELSE 'edited' END AS event_type,
  CASE WHEN CAST(key AS BIGINT) % 7 = 0 THEN NULL ELSE value END AS value FROM old)"""


def _changes(log: VersionLog, ts: int) -> DataFrame:
    """Edits of the snapshot: every third key is put as it is, every seventh is removed."""
    k = F.col("key").cast("long")
    gone = k % 7 == 0
    return log.snapshot("master", ts).select(
        "keyspace", "key", F.when(gone, "D").otherwise("P").alias("op"),
        F.when(gone, None).when(k % 3 == 0, F.col("event_type")).otherwise("edited").alias("event_type"),
        F.when(~gone, F.col("value")).alias("value"),
    )


@query("dup_version_elim", f"""WITH {LOG}, {_snap('master', T_READ, 'old')}, {CHANGES}
    SELECT c.keyspace, c.key, c.op, c.event_type, c.value FROM changes c JOIN old o ON c.keyspace = o.keyspace AND c.key = o.key
    WHERE c.op = 'D' OR c.event_type IS DISTINCT FROM o.event_type OR c.value IS DISTINCT FROM o.value""")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return tx.eliminate_duplicates(_changes(log, T_READ), log, "master", T_READ)


@query("dup_versions_in_log", f"""WITH {LOG}, l AS (SELECT *, lag(op) OVER w AS o, lag(event_type) OVER w AS e, lag(value) OVER w AS v FROM log
    WINDOW w AS (PARTITION BY branch, keyspace, key ORDER BY ts))
    SELECT branch, keyspace, key, ts, op FROM l WHERE NOT (o IS NOT NULL AND o = op AND e IS NOT DISTINCT FROM event_type AND v IS NOT DISTINCT FROM value)""")
def _(spark, sf):
    return tx.drop_repeated_versions(D.event_log(spark, sf)).select("branch", "keyspace", "key", "ts", "op")


T_TX = T0 + 29 * DAY + DAY // 2
CONFLICTS = f"""{LOG}, {_snap('master', T_TX, 'old')}, {_snap('master', FOREVER, 'heads', '1 = 1')}, {CHANGES},
  moved AS (SELECT c.keyspace, c.key, c.op, c.event_type, c.value, h.op AS t_op, h.event_type AS t_type, h.value AS t_value, h.ts AS target_ts
    FROM changes c JOIN heads h ON c.keyspace = h.keyspace AND c.key = h.key WHERE h.ts > {T_TX}),
  free AS (SELECT c.* FROM changes c ANTI JOIN moved m ON c.keyspace = m.keyspace AND c.key = m.key)"""


@query("conflicts_found", f"WITH {CONFLICTS} SELECT keyspace, key, op AS source_op, t_op AS target_op, target_ts FROM moved")
def _(spark, sf):
    log = D.event_log(spark, sf)
    found = tx.conflicts(_changes(log, T_TX), log, "master", T_TX)
    return found.select("keyspace", "key", F.col("source.op").alias("source_op"), F.col("target.op").alias("target_op"), "target_ts")


@query("conflict_source_wins", f"""WITH {CONFLICTS} SELECT * FROM free UNION ALL SELECT keyspace, key, op, event_type, value FROM moved
    WHERE op <> t_op OR event_type IS DISTINCT FROM t_type OR value IS DISTINCT FROM t_value""")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return tx.resolve(_changes(log, T_TX), log, "master", T_TX, tx.OVERWRITE_WITH_SOURCE)


@query("conflict_target_wins", f"WITH {CONFLICTS} SELECT * FROM free")
def _(spark, sf):
    log = D.event_log(spark, sf)
    return tx.resolve(_changes(log, T_TX), log, "master", T_TX, tx.OVERWRITE_WITH_TARGET)


@query("conflict_custom", f"""WITH {CONFLICTS}, r AS (SELECT *, coalesce(value, -1) >= coalesce(t_value, -1) AS mine FROM moved)
    SELECT * FROM free UNION ALL SELECT keyspace, key, op, event_type, value FROM r
    WHERE mine AND (op <> t_op OR event_type IS DISTINCT FROM t_type OR value IS DISTINCT FROM t_value)""")
def _(spark, sf):
    log = D.event_log(spark, sf)

    def larger(s, t, a):
        return F.when(F.coalesce(s["value"], F.lit(-1.0)) >= F.coalesce(t["value"], F.lit(-1.0)), s).otherwise(t)

    return tx.resolve(_changes(log, T_TX), log, "master", T_TX, larger)


_MAPS = """m AS (SELECT p_partkey AS id, p_size, p_partkey % 5 AS r FROM part)"""


@query("property_merge", f"""WITH {_MAPS}, x AS (SELECT id, CASE WHEN r = 1 THEN 'mine' ELSE 'base' END AS s, CASE WHEN r IN (1, 2) THEN 'theirs' ELSE 'base' END AS t FROM m)
    SELECT id, CASE WHEN s <> 'base' AND t <> 'base' THEN s WHEN s <> 'base' THEN s ELSE t END AS color, CASE WHEN id % 3 = 0 THEN 'y' END AS extra FROM x""")
def _(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    r = F.col("id") % 5
    base = F.create_map(F.lit("color"), F.lit("base"))
    mine = F.create_map(F.lit("color"), F.when(r == 1, "mine").otherwise("base"))
    mine = F.when(F.col("id") % 3 == 0, F.map_concat(mine, F.create_map(F.lit("extra"), F.lit("y")))).otherwise(mine)
    theirs = F.create_map(F.lit("color"), F.when(r.isin(1, 2), "theirs").otherwise("base"))
    m = tx.merge_maps(mine, theirs, base, source_wins=True)
    return p.withColumn("m", m).select("id", F.col("m")["color"].alias("color"), F.col("m")["extra"].alias("extra"))


@query("property_status", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'MODIFIED' ELSE 'PERSISTED' END AS a,
    CASE WHEN p_partkey % 3 = 0 THEN 'REMOVED' ELSE 'PERSISTED' END AS b, CASE WHEN p_partkey % 5 = 0 THEN 'NEW' END AS c FROM part""")
def _(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    n = F.col("id")
    before = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    after = F.create_map(F.lit("a"), F.when(n % 2 == 0, "2").otherwise("1"))
    after = F.when(n % 3 == 0, after).otherwise(F.map_concat(after, F.create_map(F.lit("b"), F.lit("1"))))
    after = F.when(n % 5 == 0, F.map_concat(after, F.create_map(F.lit("c"), F.lit("1")))).otherwise(after)
    s = tx.property_status(before, after)
    return p.withColumn("s", s).select("id", *[F.col("s")[c].alias(c) for c in "abc"])


@query("tx_commit_head", f"""WITH {LOG}, {_snap('master', FOREVER)} SELECT keyspace, key, event_type, value FROM snap WHERE NOT (keyspace = 'default' AND key IN ('1', '2', '3'))
    UNION ALL SELECT 'default', '1', 'manual', 1.5 UNION ALL SELECT 'default', '3', 'manual', 2.5""")
def _(spark, sf):
    store = tx.Store(D.event_log(spark, sf))
    t = store.tx()
    t.put("1", ("first", 0.5))
    t.put("1", ("manual", 1.5))
    t.remove("2")
    t.put("3", ("manual", 2.5))
    t.commit("three keys")
    return store.log.snapshot().select("keyspace", "key", "event_type", "value")


# -- dateback -------------------------------------------------------------------------------------


def _after(name: str, sql_log: str, change: Callable[[Dateback], VersionLog]) -> None:
    @query(f"dateback_{name}", f"WITH {LOG}, edited AS ({sql_log}), {_snap('exp', T_READ, log='edited')} SELECT keyspace, key, ts, event_type, value FROM snap")
    def _(spark, sf):
        return change(Dateback(D.event_log(spark, sf))).snapshot("exp", T_READ).select("keyspace", "key", "ts", "event_type", "value")


_KEY = "branch = 'master' AND keyspace = 'default' AND key = '8'"
_LAST = f"(SELECT max(ts) FROM log WHERE {_KEY} AND ts <= {T_DEV})"


def _last_of_8(d: Dateback) -> int:
    own = (F.col("branch") == "master") & (F.col("keyspace") == "default") & (F.col("key") == "8") & (F.col("ts") <= T_DEV)
    return d.log.rows.filter(own).agg(F.max("ts")).first()[0] or 0


_after("purge_entry", f"SELECT * FROM log WHERE NOT ({_KEY} AND ts = coalesce({_LAST}, 0))", lambda d: d.purge_entry("8", _last_of_8(d)))
_after("purge_key", f"SELECT * FROM log WHERE NOT ({_KEY})", lambda d: d.purge_key("8"))
_after("purge_key_where", f"SELECT * FROM log WHERE NOT ({_KEY} AND coalesce(value > 20, false))", lambda d: d.purge_key("8", where=F.coalesce(F.col("value") > 20, F.lit(False))))
_after("purge_key_range", f"SELECT * FROM log WHERE NOT ({_KEY} AND ts BETWEEN {T0 + 2 * DAY} AND {T0 + 8 * DAY})", lambda d: d.purge_key("8", lo=T0 + 2 * DAY, hi=T0 + 8 * DAY))
_after("purge_range", f"SELECT * FROM log WHERE NOT (branch = 'master' AND keyspace = 'vip' AND ts BETWEEN {T0 + DAY} AND {T0 + 6 * DAY})", lambda d: d.purge_keyspace("vip", T0 + DAY, T0 + 6 * DAY))
_after("purge_commits", f"SELECT * FROM log WHERE NOT (branch = 'master' AND ts BETWEEN {T0 + 3 * DAY} AND {T0 + 9 * DAY})", lambda d: d.purge_commits(T0 + 3 * DAY, T0 + 9 * DAY))
_after(
    "inject", f"SELECT * FROM log UNION ALL SELECT 'master', 'default', 'injected', {T0 + 5}, 'P', 'late', 9.5",
    lambda d: d.inject(d.log.rows.sparkSession.createDataFrame([("default", "injected", T0 + 5, "P", "late", 9.5)], "keyspace string, key string, ts long, op string, event_type string, value double")),
)
_after("transform_entry", f"SELECT branch, keyspace, key, ts, op, CASE WHEN {_KEY} AND op = 'P' AND ts = coalesce({_LAST}, 0) THEN 'x' ELSE event_type END AS event_type, value FROM log",
       lambda d: d.transform_entry("8", _last_of_8(d), lambda n, c: F.lit("x") if n == "event_type" else c))
_after("transform_key", f"SELECT branch, keyspace, key, ts, op, event_type, CASE WHEN {_KEY} AND op = 'P' THEN value * 2 ELSE value END AS value FROM log",
       lambda d: d.transform_values_of_key("8", lambda n, c: c * 2 if n == "value" else c))
_after("transform_keyspace", "SELECT branch, keyspace, key, ts, op, CASE WHEN branch = 'master' AND keyspace = 'vip' THEN upper(event_type) ELSE event_type END AS event_type, value FROM log",
       lambda d: d.transform_values_of_keyspace("vip", lambda n, c: F.upper(c) if n == "event_type" else c))


# -- graph ----------------------------------------------------------------------------------------

GRAPH = """v AS (SELECT 'c' || c_custkey AS id, 'customer' AS label, c_name AS name, c_acctbal AS balance, NULL::VARCHAR[] AS words, NULL::BIGINT AS size FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_acctbal, NULL, NULL FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'region', r_name, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'p' || p_partkey, 'part', p_name, NULL, string_split(p_name, ' '), CAST(p_size AS BIGINT) FROM part),
e AS (SELECT 'l' || c_custkey AS id, 'livesIn' AS label, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'b' || s_suppkey, 'basedIn', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'o' || n_nationkey, 'partOf', 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'h' || p_partkey, 'half', 'p' || p_partkey, 'p' || (p_partkey // 2) FROM part WHERE p_partkey > 0
  UNION ALL SELECT 'x' || l_orderkey || '-' || l_linenumber, 'bought', 'c' || min(o_custkey), 'p' || min(l_partkey)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)"""


def _graph_query(name: str, sql: str):
    return query(f"graph_{name}", f"WITH {GRAPH} {sql}")


@_graph_query("all_vertices", "SELECT id, label FROM v")
def _(spark, sf):
    return D.graph(spark, sf).V().value_map("label").select(F.col("it").alias("id"), "label")


@_graph_query("all_edges", "SELECT label, count(*) AS n FROM e GROUP BY label")
def _(spark, sf):
    return D.graph(spark, sf).E().group_count("label").select(F.col("group").alias("label"), "n")


@_graph_query("by_id", "SELECT id, name FROM v WHERE id IN ('c1', 'n3', 'zz')")
def _(spark, sf):
    return D.graph(spark, sf).V("c1", "n3", "zz").value_map("name").select(F.col("it").alias("id"), "name")


GRAPH_PREDICATES = {
    "cp_gt": (("balance", P.gt(5000)), "balance > 5000"),
    "cp_gte": (("size", P.gte(40)), "size >= 40"),
    "cp_lt": (("balance", P.lt(0.0)), "balance < 0"),
    "cp_lte": (("size", P.lte(3)), "size <= 3"),
    "cp_eq": (("size", P.eq(7)), "size = 7"),
    "cp_neq": (("size", P.neq(7)), "size <> 7"),
    "cp_eq_tol": (("balance", P.eq(1863.5, 0.5)), "abs(balance - 1863.5) < 0.5"),
    "cp_neq_tol": (("balance", P.neq(1863.5, 0.5)), "abs(balance - 1863.5) >= 0.5"),
    "cp_within": (("words", P.within("ring", "bolt")), "list_has_any(words, ['ring', 'bolt'])"),
    "cp_without": (("words", P.without("ring", "bolt")), "NOT list_has_any(words, ['ring', 'bolt'])"),
    "cp_within_ci": (("words", P.within("RING", ignore_case=True)), "list_has_any(words, ['ring'])"),
    "cp_within_tol": (("balance", P.within(1863.5, 73.2, tolerance=0.5)), "abs(balance - 1863.5) <= 0.5 OR abs(balance - 73.2) <= 0.5"),
    "cp_long_within": (("size", P.within(1, 2, 3)), "size IN (1, 2, 3)"),
    "cp_long_without": (("size", P.without(1, 2, 3)), "size NOT IN (1, 2, 3)"),
    "cp_inside": (("size", P.inside(10, 20)), "size > 10 AND size < 20"),
    "cp_outside": (("size", P.outside(10, 40)), "size < 10 OR size > 40"),
    "cp_between": (("size", P.between(10, 20)), "size >= 10 AND size < 20"),
    "cp_starts": (("words", P.starts_with("b")), _any("starts_with(w, 'b')")),
    "cp_not_starts": (("words", P.not_starts_with("b")), _none("starts_with(w, 'b')")),
    "cp_ends_ci": (("words", P.ends_with_ignore_case("G")), _any("ends_with(w, 'g')")),
    "cp_contains": (("name", P.contains("#00000001")), "contains(name, '#00000001')"),
    "cp_not_contains_ci": (("words", P.not_contains_ignore_case("IN")), _none("contains(w, 'in')")),
    "cp_regex": (("name", P.matches_regex("Customer#0+[1-9]")), "regexp_full_match(name, 'Customer#0+[1-9]')"),
    "cp_not_regex_ci": (("words", P.not_matches_regex_ignore_case("[A-M].*")), _none("regexp_full_match(w, '[a-m].*')")),
    "cp_equals_ci": (("words", P.equals_ignore_case("RING")), "list_contains(words, 'ring')"),
    "cp_many_to_many": (("words", P.eq(["small", "ring"])), "len(words) > 1 AND len(list_filter(words, lambda w: w NOT IN ('small', 'ring'))) = 0"),
    "cp_and_or": (("size", P.or_(P.and_(P.gt(5), P.lt(8)), P.eq(30))), "(size > 5 AND size < 8) OR size = 30"),
    "cp_not": (("size", P.not_(P.or_(P.lt(10), P.gt(40)))), "size >= 10 AND size <= 40"),
}
for _name, ((_prop, _test), _sql) in GRAPH_PREDICATES.items():

    @_graph_query(_name, f"SELECT id FROM v WHERE {_prop} IS NOT NULL AND ({_sql})")
    def _(spark, sf, prop=_prop, test=_test):
        return D.graph(spark, sf).V().has(prop, test).rows.select(F.col("it").alias("id"))


@_graph_query("out_label", "SELECT e.dst AS id, count(*) AS n FROM e JOIN v ON v.id = e.src WHERE e.label = 'bought' AND v.balance > 9000 GROUP BY e.dst")
def _(spark, sf):
    return D.graph(spark, sf).V().has("balance", P.gt(9000)).out("bought").group_count().select(F.col("group").alias("id"), "n")


@_graph_query("in_both", "SELECT id, count(*) AS n FROM (SELECT dst AS id FROM e WHERE src IN ('n1', 'n2') UNION ALL SELECT src FROM e WHERE dst IN ('n1', 'n2')) GROUP BY id")
def _(spark, sf):
    return D.graph(spark, sf).V("n1", "n2").both().group_count().select(F.col("group").alias("id"), "n")


@_graph_query("edge_steps", "SELECT DISTINCT a.id AS edge, b.dst AS region FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'basedIn' AND b.label = 'partOf'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("supplier").out_e("basedIn").as_("edge").in_v().out("partOf").dedup("edge", "it")
    return t.rows.select("edge", F.col("it").alias("region"))


@_graph_query("other_v", "SELECT e.id AS edge, e.src AS id FROM e WHERE e.dst = 'n5' UNION ALL SELECT e.id, e.dst FROM e WHERE e.src = 'n5'")
def _(spark, sf):
    t = D.graph(spark, sf).V("n5").as_("n").both_e().as_("edge").other_v("n")
    return t.rows.select("edge", F.col("it").alias("id"))


@_graph_query("where_not", "SELECT id FROM v WHERE label = 'nation' AND id IN (SELECT dst FROM e WHERE label = 'basedIn') AND id NOT IN (SELECT e.dst FROM e JOIN v c ON c.id = e.src WHERE e.label = 'livesIn' AND c.balance > 9900)")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").where(lambda x: x.in_("basedIn")).not_(lambda x: x.in_("livesIn").has("balance", P.gt(9900)))
    return t.rows.select(F.col("it").alias("id"))


@_graph_query("and_or", "SELECT id FROM v WHERE label = 'part' AND (id IN (SELECT dst FROM e JOIN v c ON c.id = e.src WHERE e.label = 'bought' AND c.balance > 9500) OR size > 45)")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("part").or_(lambda x: x.in_("bought").has("balance", P.gt(9500)), lambda x: x.has("size", P.gt(45)))
    return t.rows.select(F.col("it").alias("id"))


@_graph_query("values", "SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM v) GROUP BY w")
def _(spark, sf):
    return D.graph(spark, sf).V().values("words").group_count().select(F.col("group").alias("w"), "n")


@_graph_query("value_map", "SELECT id, name, balance FROM v WHERE label = 'supplier'")
def _(spark, sf):
    return D.graph(spark, sf).V().has_label("supplier").value_map("name", "balance").withColumnRenamed("it", "id")


@_graph_query("order_by", "SELECT row_number() OVER (ORDER BY balance DESC NULLS LAST, id) AS place, id, balance FROM v WHERE label IN ('customer', 'nation')")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("customer", "nation").order_by(("balance", True))
    return _placed(t.withColumnRenamed("it", "id"), ["id", "balance"])


@_graph_query("aggregates", "SELECT min(balance) AS lo, max(balance) AS hi, count(balance) AS n FROM v WHERE label = 'customer'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("customer").values("balance")
    return t.rows.agg(F.min("it").alias("lo"), F.max("it").alias("hi"), F.count("it").alias("n"))


@_graph_query("group", "SELECT dst AS nation, list_sort(list(src)) AS members FROM e WHERE label = 'basedIn' GROUP BY dst")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("supplier").as_("s").out("basedIn")
    return t.rows.groupBy(F.col("it").alias("nation")).agg(F.sort_array(F.collect_list("s")).alias("members"))


@_graph_query("closure", """, RECURSIVE_OUT(seed, id) AS (SELECT src, dst FROM e WHERE label = 'half' AND src IN ('p37', 'p500')
    UNION SELECT r.seed, e.dst FROM RECURSIVE_OUT r JOIN e ON e.src = r.id WHERE e.label = 'half') SELECT seed, id FROM RECURSIVE_OUT WHERE seed <> id""")
def _(spark, sf):
    t = D.graph(spark, sf).V("p37", "p500").as_("seed").closure(lambda x: x.out("half"))
    return t.rows.select("seed", F.col("it").alias("id"))


_S["graph_closure"] = _S["graph_closure"].replace("WITH v AS", "WITH RECURSIVE v AS").replace(") , RECURSIVE_OUT", "), RECURSIVE_OUT")


@_graph_query("repeat_times", "SELECT c.dst AS id FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.label = 'half' AND b.label = 'half' AND c.label = 'half'")
def _(spark, sf):
    return D.graph(spark, sf).V().has_label("part").repeat(lambda x: x.out("half"), 3).rows.select(F.col("it").alias("id"))


@_graph_query("repeat_until", """, RECURSIVE_OUT(id) AS (SELECT e.dst FROM e JOIN v ON v.id = e.src WHERE e.label = 'half' AND v.label = 'part'
    UNION ALL SELECT e.dst FROM RECURSIVE_OUT r JOIN e ON e.src = r.id WHERE e.label = 'half' AND CAST(r.id[2:] AS BIGINT) >= 16)
    SELECT id FROM RECURSIVE_OUT WHERE CAST(id[2:] AS BIGINT) < 16""")
def _(spark, sf):
    n = F.col("it").substr(2, 20).cast("long")
    # a long is halved to nothing in 63 rounds, and rounds end with the traversers
    t = D.graph(spark, sf).V().has_label("part").repeat_until(lambda x: x.out("half"), lambda x: x.filter(lambda c: n < 16), 64)
    return t.rows.select(F.col("it").alias("id"))


_S["graph_repeat_until"] = _S["graph_repeat_until"].replace("WITH v AS", "WITH RECURSIVE v AS").replace(") , RECURSIVE_OUT", "), RECURSIVE_OUT")


@_graph_query("simple_paths", "SELECT a.src || '>' || a.dst AS path FROM e a WHERE a.label = 'half' AND a.src = 'p9' UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'half' AND b.label = 'half' AND a.src = 'p9'")
def _(spark, sf):
    paths = D.graph(spark, sf).V("p9").simple_paths(lambda x: x.out("half"), 2)
    return paths.select(F.array_join("path", ">").alias("path"))


@_graph_query("as_select", "SELECT e.src AS id FROM e JOIN v n ON n.id = e.dst WHERE e.label = 'livesIn' AND n.name = 'NATION_3'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("customer").as_("c").out("livesIn").has("name", P.eq("NATION_3")).select("c")
    return t.rows.select(F.col("it").alias("id"))


@_graph_query("union_except", "SELECT dst AS id FROM e WHERE src = 'c1' AND dst <> 'p3' UNION ALL SELECT dst FROM e WHERE src = 'c2' AND dst <> 'p3'")
def _(spark, sf):
    g = D.graph(spark, sf)
    t = g.V("c1").out()._with(g.V("c1").out().rows.unionByName(g.V("c2").out().rows)).except_(g.V("p3"))
    return t.rows.select(F.col("it").alias("id"))


@_graph_query("coalesce", "SELECT coalesce(e.src, v.id) AS id FROM v LEFT JOIN (SELECT * FROM e WHERE label = 'basedIn') e ON e.dst = v.id WHERE v.label = 'nation'")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").optional(lambda x: x.in_("basedIn"))
    return t.rows.select(F.col("it").alias("id"))


@_graph_query("map_is", "SELECT size * 2 AS x FROM v WHERE size * 2 > 60")
def _(spark, sf):
    t = D.graph(spark, sf).V().values("size").map(lambda c: c * 2).is_(lambda c: c > 60)
    return t.rows.select(F.col("it").alias("x"))


@_graph_query("project", "SELECT v.id, list_sort(list(e.src) FILTER (e.src IS NOT NULL)) AS suppliers FROM v LEFT JOIN (SELECT * FROM e WHERE label = 'basedIn') e ON e.dst = v.id WHERE v.label = 'nation' GROUP BY v.id")
def _(spark, sf):
    t = D.graph(spark, sf).V().has_label("nation").project(suppliers=lambda x: x.in_("basedIn"))
    return t.withColumnRenamed("it", "id")


@_graph_query("subgraph", "SELECT DISTINCT v.id, v.label FROM v JOIN e ON e.label = 'basedIn' AND (v.id = e.src OR v.id = e.dst)")
def _(spark, sf):
    g = D.graph(spark, sf)
    return subgraph(g, g.E().has_label("basedIn")).vertices.select("id", "label")


@_graph_query("remove_vertices", "SELECT label, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM v WHERE label = 'nation') AND dst NOT IN (SELECT id FROM v WHERE label = 'nation') GROUP BY label")
def _(spark, sf):
    g = D.graph(spark, sf)
    left = remove_vertices(g, g.vertices.filter("label = 'nation'").select("id"))
    return left.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@_graph_query("set_property", "SELECT id, CASE WHEN label = 'supplier' THEN NULL ELSE balance END AS balance FROM v WHERE label IN ('supplier', 'customer')")
def _(spark, sf):
    g = D.graph(spark, sf)
    g = set_property(g, g.vertices.filter("label = 'supplier'").select("id"), "balance", None)
    return g.vertices.filter("label in ('supplier', 'customer')").select("id", "balance")


@_graph_query("invariants", "SELECT id FROM e WHERE src NOT IN (SELECT id FROM v WHERE label <> 'region') OR dst NOT IN (SELECT id FROM v WHERE label <> 'region')")
def _(spark, sf):
    g = D.graph(spark, sf)
    g.vertices = g.vertices.filter("label <> 'region'")
    return g.dangling_edges()


# -- graph history --------------------------------------------------------------------------------


@query("restore_diff", f"""WITH {LOG}, {_snap('master', T0 + 15 * DAY, 'a')}, {_snap('master', FOREVER, 'b')}
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'D' ELSE 'P' END AS op, a.event_type, a.value
    FROM (SELECT * FROM a WHERE keyspace = 'default') a FULL JOIN (SELECT * FROM b WHERE keyspace = 'default') b ON a.key = b.key
    WHERE a.key IS NULL OR b.key IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value""")
def _(spark, sf):
    return gh.restore(D.event_log(spark, sf), "default", T0 + 15 * DAY).drop("keyspace")


@query("element_lifecycle", f"""WITH {LOG}, {_snap('master', T0 + 5 * DAY, 'a')}, {_snap('master', T_READ, 'b')}
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'NEW' WHEN b.key IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status
    FROM (SELECT * FROM a WHERE keyspace = 'vip') a FULL JOIN (SELECT * FROM b WHERE keyspace = 'vip') b ON a.key = b.key
    WHERE a.key IS NULL OR b.key IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value""")
def _(spark, sf):
    log, own = D.event_log(spark, sf), F.col("keyspace") == "vip"
    d = gh.diff(log.snapshot("master", T0 + 5 * DAY, own), log.snapshot("master", T_READ, own), log.payload)
    return d.select("key", "status")


@query("coordinates", f"""WITH {LOG}, c AS (SELECT DISTINCT branch, ts AS "at" FROM log WHERE ts <= {T_READ})
    SELECT branch, "at" FROM c QUALIFY row_number() OVER (PARTITION BY branch ORDER BY "at" DESC) <= 25""")
def _(spark, sf):
    return gh.coordinates(D.event_log(spark, sf), hi=T_READ, limit=25)


@query("changed_prev", f"""WITH {LOG}, s AS (SELECT * FROM ({_seen('exp', T_READ)}) WHERE keyspace = 'vip')
    SELECT key, "at", removed, previous_at FROM (SELECT key, ts AS "at", op = 'D' AS removed, lag(ts) OVER (PARTITION BY key ORDER BY ts, depth DESC) AS previous_at FROM s)
    WHERE "at" >= {T0 + 10 * DAY}""")
def _(spark, sf):
    return gh.changed_with_previous(D.event_log(spark, sf), "vip", "exp", T0 + 10 * DAY, T_READ)


def _order_edges(spark, sf) -> VersionLog:
    """Orders as versioned edges from a customer to a priority, one key for each pair."""
    o = D.table(spark, sf, "orders")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    o = o.select(
        F.lit("master").alias("branch"), F.lit("edge").alias("keyspace"), F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"),
        ms.alias("ts"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"), "o_orderkey", "o_orderstatus",
    )
    last = o.groupBy("branch", "keyspace", "key", "ts").agg(F.max_by(F.struct("src", "dst", "o_orderstatus"), "o_orderkey").alias("v"))
    return VersionLog(last.select("branch", "keyspace", "key", "ts", F.when(F.col("v.o_orderstatus") == "F", "D").otherwise("P").alias("op"), "v.src", "v.dst"))


@query("changed_prev_neighbourhood", """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS src, o_orderpriority AS dst, epoch_us(o_orderdate) // 1000 AS ts, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1),
    val AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY src, dst ORDER BY ts), 9223372036854775807) AS valid_to FROM o),
    c AS (SELECT DISTINCT src AS key, ts AS "at" FROM o)
    SELECT DISTINCT c.key, c."at", v.dst AS neighbour FROM c JOIN val v ON v.src = c.key AND v.ts <= c."at" - 1 AND v.valid_to > c."at" - 1 WHERE v.o_orderstatus <> 'F'""")
def _(spark, sf):
    edges = _order_edges(spark, sf)
    changes = edges.rows.select(F.col("src").alias("key"), F.col("ts").alias("at")).distinct()
    return gh.previous_neighbourhood(changes, edges)


@query("validators", f"""WITH {PARTS} SELECT 'has size' AS rule, key FROM parts WHERE size IS NULL
    UNION ALL SELECT 'cheap', key FROM parts WHERE NOT coalesce(price < 950, false)""")
def _(spark, sf):
    rules = [gh.Rule("has size", lambda: F.col("size").isNotNull()), gh.Rule("cheap", lambda: F.col("price") < 950)]
    return gh.validate(D.part_log(spark, sf).snapshot(), rules)


# -- model ----------------------------------------------------------------------------------------

MODEL = f"{GRAPH}, o AS (SELECT id, upper(label[1]) || label[2:] AS eclass, name, balance FROM v WHERE label <> 'part')"


def _model_query(name: str, sql: str):
    return query(f"model_{name}", f"WITH {MODEL} {sql}")


def _ids(objects) -> DataFrame:
    return objects.to_df()


@_model_query("all", "SELECT id FROM o")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_all())


@_model_query("instances_exact", "SELECT id FROM o WHERE eclass = 'Nation'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_instances_of("shop::Nation"))


@_model_query("instance_of_subclass", "SELECT id FROM o WHERE eclass IN ('Customer', 'Supplier')")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_all().is_instance_of("Party"))


@_model_query("has_attribute", "SELECT id FROM o WHERE name = 'NATION_7'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_all().has("name", "NATION_7"))


@_model_query("has_reference", "SELECT src AS id FROM e WHERE label = 'basedIn' AND dst = 'n4'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_all().has("basedIn", "n4"))


@_model_query("with_value", "SELECT id FROM o WHERE name = 'ASIA'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_objects_with("name", "ASIA"))


@_model_query("e_get_reference", "SELECT DISTINCT dst AS id FROM e WHERE label = 'basedIn'")
def _(spark, sf):
    return D.model(spark, sf).find().from_instances_of("Supplier").e_get("basedIn").to_set()


@_model_query("e_get_ordered", "SELECT o.id AS it, CAST(e.src[2:] AS BIGINT) AS pos, e.src AS target FROM o LEFT JOIN e ON e.dst = o.id AND e.label = 'partOf' WHERE o.eclass = 'Region'")
def _(spark, sf):
    return D.model(spark, sf).find().from_instances_of("Region").e_get_ordered("nations")


@_model_query("e_get_attribute", "SELECT balance AS x FROM o WHERE eclass = 'Supplier' AND balance IS NOT NULL")
def _(spark, sf):
    return D.model(spark, sf).find().from_instances_of("Supplier").e_get("balance").to_df("x")


@_model_query("e_get_inverse", "SELECT src AS id FROM e WHERE label = 'livesIn' AND dst IN ('n1', 'n2')")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_objects("n1", "n2").e_get_inverse("livesIn"))


@_model_query("container", "SELECT dst AS id FROM e WHERE label = 'partOf'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_instances_of("Nation").e_container())


@_model_query("contents", "SELECT src AS id FROM e WHERE label = 'partOf' AND dst = 'r2'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_objects("r2").e_contents())


@_model_query("all_contents", "SELECT src AS id FROM e WHERE label = 'partOf' AND dst = 'r2' UNION ALL SELECT l.src FROM e l JOIN e p ON l.dst = p.src WHERE l.label = 'livesIn' AND p.label = 'partOf' AND p.dst = 'r2'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_objects("r2").e_all_contents())


@_model_query("all_referencing", "SELECT DISTINCT src AS id FROM e WHERE dst = 'n3' AND label IN ('livesIn', 'basedIn') UNION SELECT dst FROM e WHERE src = 'n3' AND label = 'partOf'")
def _(spark, sf):
    return D.model(spark, sf).find().from_objects("n3").all_referencing().to_set()


@_model_query("closure", "SELECT dst AS id FROM e WHERE label = 'partOf' AND src = 'n3'")
def _(spark, sf):
    return _ids(D.model(spark, sf).find().from_objects("n3").closure("eContainer"))


@_model_query("subqueries", "SELECT id FROM o WHERE eclass = 'Nation' AND id IN (SELECT dst FROM e WHERE label = 'basedIn') AND id NOT IN (SELECT l.dst FROM e l JOIN o c ON c.id = l.src WHERE l.label = 'livesIn' AND c.balance < -900)")
def _(spark, sf):
    q = D.model(spark, sf).find().from_instances_of("Nation")
    q = q.and_(lambda x: x.e_get_inverse("basedIn")).not_(lambda x: x.e_get_inverse("livesIn").filter(lambda c: c < -900, "balance"))
    return _ids(q)


@_model_query("union", "SELECT dst AS id FROM e WHERE label IN ('partOf') AND src = 'n3' UNION ALL SELECT src FROM e WHERE label = 'basedIn' AND dst = 'n3'")
def _(spark, sf):
    q = D.model(spark, sf).find().from_objects("n3")
    return _ids(q.union(lambda x: x.e_container(), lambda x: x.e_get_inverse("basedIn")))


@_model_query("except", "SELECT id FROM o WHERE eclass = 'Region' AND id <> 'r1'")
def _(spark, sf):
    m = D.model(spark, sf)
    return _ids(m.find().from_instances_of("Region").except_(m.find().from_objects("r1")))


@_model_query("named_back", "SELECT e.src AS id FROM e JOIN e p ON p.src = e.dst AND p.label = 'partOf' WHERE e.label = 'basedIn' AND p.dst = 'r0'")
def _(spark, sf):
    q = D.model(spark, sf).find().from_instances_of("Supplier").named("s").e_get("basedIn").e_container()
    return _ids(q.filter(lambda c: c == "r0").back("s"))


@_model_query("order_by", "SELECT row_number() OVER (ORDER BY balance ASC NULLS FIRST, id) AS place, id FROM o")
def _(spark, sf):
    rows = D.model(spark, sf).find().from_all().order_by("balance")
    return _placed(rows.withColumnRenamed("it", "id"), ["id"])


@_model_query("rounding", "SELECT id, CAST(CASE WHEN balance - floor(balance) >= 0.5 THEN floor(balance) + 1 ELSE floor(balance) END AS BIGINT) AS r, CAST(floor(balance) AS BIGINT) AS f, CAST(ceil(balance) AS BIGINT) AS c, CAST(trunc(balance) AS BIGINT) AS t FROM o WHERE balance IS NOT NULL")
def _(spark, sf):
    x = F.col("balance")
    rows = D.model(spark, sf).objects.filter("balance is not null")
    return rows.select("id", numbers.round_half_up(x).alias("r"), F.floor(x).cast("long").alias("f"), F.ceil(x).cast("long").alias("c"), numbers.as_number(x, "long").alias("t"))


@_model_query("narrowing", "SELECT id, ((CAST(trunc(balance) AS BIGINT) + 128) % 256 + 256) % 256 - 128 AS b FROM o WHERE balance IS NOT NULL")
def _(spark, sf):
    rows = D.model(spark, sf).objects.filter("balance is not null")
    return rows.select("id", numbers.as_number(F.col("balance"), "byte").cast("long").alias("b"))


@_model_query("aggregates", "SELECT CAST(sum(CAST(trunc(balance) AS BIGINT)) AS BIGINT) AS total, CAST(min(trunc(balance)) AS BIGINT) AS lo, CAST(max(trunc(balance)) AS BIGINT) AS hi, count(*) AS n FROM o WHERE eclass = 'Customer' AND balance IS NOT NULL")
def _(spark, sf):
    q = D.model(spark, sf).find().from_instances_of("Customer").e_get("balance")
    x = F.col("it")
    as_long = numbers.as_number(x, "long")
    return q.t.rows.agg(numbers.sum_as_long(x).alias("total"), F.min(as_long).alias("lo"), F.max(as_long).alias("hi"), F.count(F.lit(1)).alias("n"))


@_model_query("average", "SELECT round(sum(balance) / count(*), 6) AS result FROM o WHERE eclass = 'Supplier'")
def _(spark, sf):
    return D.model(spark, sf).find().from_instances_of("Supplier").e_get("balance").average().select(F.round("result", 6).alias("result"))


@_model_query("evolution", "SELECT id, CASE WHEN eclass IN ('Customer', 'Supplier') THEN 'Party' ELSE 'Place' END AS eclass, upper(name) AS name FROM o WHERE eclass <> 'Region'")
def _(spark, sf):
    m = D.model(spark, sf)
    c = F.col("eclass")
    new = F.when(c.isin("Customer", "Supplier"), "Party").when(c == "Nation", "Place")
    out = evolve(m, m.metamodel, lambda: new, lambda d: d.withColumn("name", F.upper("name")))
    return out.objects.select("id", "eclass", "name")


@_model_query("delete_cascade", "SELECT id FROM o WHERE id <> 'r2' AND id NOT IN (SELECT src FROM e WHERE label = 'partOf' AND dst = 'r2') AND id NOT IN (SELECT l.src FROM e l JOIN e p ON l.dst = p.src WHERE l.label = 'livesIn' AND p.label = 'partOf' AND p.dst = 'r2')")
def _(spark, sf):
    m = D.model(spark, sf)
    left: Model = delete_cascade(m, spark.createDataFrame([("r2",)], "id string"))
    return left.objects.select("id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import store_queries  # noqa: F401 - registers its queries here

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_S)
