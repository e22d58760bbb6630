"""Reading and writing logs: partitioned Parquet, dumps, incremental backups, graph exchange."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.branches import Branch, BranchTree
from ..plans.versions import META, VersionLog


def _text(spark: SparkSession, path: str, value) -> None:
    """A small JSON document, written and read by Spark alone, so any file system will do."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])


def _tree(branches: BranchTree) -> list:
    return [[b.name, b.origin, b.branching_ts] for b in branches.all()]


def write_log(log: VersionLog, path: str) -> None:
    """The log as Parquet by branch and keyspace, so that reads skip what they do not see.

    Rows are dealt by ranges of branch, keyspace, key and time, so a large keyspace, or a key with very
    many versions, is written by many tasks.
    """
    spark = log.rows.sparkSession
    order = ("branch", "keyspace", "key", "ts")
    log.rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "branch", "keyspace"
    ).parquet(f"{path}/rows")
    _text(spark, f"{path}/branches", _tree(log.branches))


def read_log(spark: SparkSession, path: str) -> VersionLog:
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("branch", "keyspace")})
    return VersionLog(rows, BranchTree([Branch(*b) for b in _read_text(spark, f"{path}/branches")]))


@dataclass
class Dump:
    """What a full dump holds beside the log: ``commits`` and ``audit`` are tables or none."""

    log: VersionLog
    commits: DataFrame | None
    audit: DataFrame | None
    indices: list[dict]


def write_dump(
    log: VersionLog, path: str, commits: DataFrame | None = None, compress: bool = False,
    converters: dict[str, Column] | None = None, audit: DataFrame | None = None, indices: list | None = None,
    aliases: dict[str, str] | None = None, batch_size: int | None = None,
) -> None:
    """A full dump as JSON lines with the branch tree, commits, dateback log and index definitions beside it.

    ``converters`` replaces payload columns by expressions; plain types need none. ``aliases`` gives
    payload columns other names in the files. ``batch_size`` is the most entries of one file.
    """
    rows = log.rows.withColumns(converters or {}).withColumnsRenamed(aliases or {})
    writer = rows.write.mode("overwrite")
    if batch_size is not None:
        writer = writer.option("maxRecordsPerFile", batch_size)
    (writer.option("compression", "gzip") if compress else writer).json(f"{path}/entries")
    meta = {"branches": _tree(log.branches), "schema": json.loads(rows.schema.json()), "written": int(time.time() * 1000)}
    for name, df in (("commits", commits), ("audit", audit)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
            meta[name] = json.loads(df.schema.json())
    meta["aliases"] = aliases or {}
    meta["indices"] = [
        {"name": x.name, "kind": x.kind, "branch": x.branch, "valid_from": x.valid_from, "valid_to": x.valid_to} for x in indices or []
    ]
    _text(rows.sparkSession, f"{path}/meta", meta)


def read_whole_dump(spark: SparkSession, path: str, converters: dict[str, Column] | None = None) -> Dump:
    """Everything that ``write_dump`` wrote. Columns have their own names again; converters see those."""
    from pyspark.sql.types import StructType

    meta = _read_text(spark, f"{path}/meta")

    def table(name: str, key: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(meta[key])).json(f"{path}/{name}")

    rows = table("entries", "schema").withColumnsRenamed({v: k for k, v in meta.get("aliases", {}).items()})
    log = VersionLog(rows.withColumns(converters or {}), BranchTree([Branch(*b) for b in meta["branches"]]))
    commits, audit = (table(n, n) if n in meta else None for n in ("commits", "audit"))
    return Dump(log, commits, audit, meta.get("indices", []))


def read_dump(spark: SparkSession, path: str, converters: dict[str, Column] | None = None) -> VersionLog:
    """The log of a dump."""
    return read_whole_dump(spark, path, converters).log


def write_incremental(
    log: VersionLog, path: str, since: int, until: int | None = None, touched: list[tuple[str, int, int]] = (),
) -> dict:
    """What was written after ``since``, with the range in a manifest; gives the manifest.

    ``touched`` are ranges (branch, lo, hi) that datebacks have changed since the last backup: their
    rows come as a whole, whatever their timestamps, and replace what older backups have there.
    """
    spark = log.rows.sparkSession
    if until is None:
        until = log.rows.agg(F.max("ts")).first()[0] or since
    part = log.rows.filter(((F.col("ts") > since) & (F.col("ts") <= until)) | _inside(touched))
    part.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = {"since": since, "until": until, "touched": [list(t) for t in touched], "branches": _tree(log.branches)}
    _text(spark, f"{path}/manifest", manifest)
    return manifest


def _inside(ranges) -> Column:
    on = F.lit(False)
    for branch, lo, hi in ranges:
        on = on | ((F.col("branch") == branch) & F.col("ts").between(lo, hi))
    return on


def read_incremental(spark: SparkSession, paths: list[str]) -> VersionLog:
    """The log of a gapless sequence of incremental backups; a gap is an error."""
    parts = sorted(((_read_text(spark, f"{p}/manifest"), p) for p in paths), key=lambda x: x[0]["since"])
    end, rows = None, None
    for m, p in parts:
        if end is not None and m["since"] > end:
            raise ValueError(f"the backups lack what was written from {end} to {m['since']}")
        touched = m.get("touched", [])
        part = spark.read.parquet(f"{p}/rows")
        if end is not None:
            part = part.filter((F.col("ts") > end) | _inside(touched))
        rows = part if rows is None else rows.filter(~_inside(touched)).unionByName(part)
        end = max(end or 0, m["until"])
    return VersionLog(rows, BranchTree([Branch(*b) for b in parts[-1][0]["branches"]]))


def write_graph(graph: Graph, path: str, form: str = "json") -> None:
    graph.vertices.write.mode("overwrite").format(form).save(f"{path}/vertices")
    graph.edges.write.mode("overwrite").format(form).save(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, form: str = "json", like: Graph | None = None) -> Graph:
    def read(name, schema):
        reader = spark.read.format(form)
        return (reader.schema(schema) if schema is not None else reader).load(f"{path}/{name}")

    return Graph(read("vertices", like and like.vertices.schema), read("edges", like and like.edges.schema))


#: What comes before and after the elements of a GraphML document.
GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
GRAPHML_TAIL = "</graph></graphml>"


def write_graphml(graph: Graph, path: str) -> None:
    """GraphML, a line per element: head, the parts of ``nodes`` and ``edges`` in order of name, and tail are the document."""
    spark = graph.vertices.sparkSession
    for name, text in (("head", GRAPHML_HEAD), ("tail", GRAPHML_TAIL)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")

    def element(tag: str, attrs: list[str], props: list[str]) -> Column:
        parts = [F.lit(f"<{tag}")]
        for a in attrs:
            name = {"src": "source", "dst": "target"}.get(a, a)
            parts += [F.lit(f' {name}="'), _escaped(F.col(a)), F.lit('"')]
        parts.append(F.lit(">"))
        for p in props:
            data = F.concat(F.lit(f'<data key="{p}">'), _escaped(F.col(p).cast("string")), F.lit("</data>"))
            parts.append(F.coalesce(data, F.lit("")))
        return F.concat(*parts, F.lit(f"</{tag}>")).alias("value")

    v = [c for c in graph.vertices.columns if c != "id"]
    e = [c for c in graph.edges.columns if c not in ("id", "src", "dst")]
    graph.vertices.select(element("node", ["id"], v)).write.mode("overwrite").text(f"{path}/nodes")
    graph.edges.select(element("edge", ["id", "src", "dst"], e)).write.mode("overwrite").text(f"{path}/edges")


#: What XML writes for characters that it gives a meaning or would not keep.
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"))


def _escaped(c: Column) -> Column:
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescaped(c: Column) -> Column:
    for a, b in reversed(_ENTITIES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def read_graphml(spark: SparkSession, path: str, like: Graph) -> Graph:
    """What ``write_graphml`` wrote, a line per element; ``like`` names the columns and their types.

    Columns of arrays and structs come as the text that they were written as, if ``like`` says string.
    """
    def read(name: str, schema, ends: dict[str, str]) -> DataFrame:
        line = spark.read.text(f"{path}/{name}")

        def column(f):
            if f.name in ends:
                pattern = f' {ends[f.name]}="([^"]*)"'
            else:
                pattern = f'<data key="{f.name}">([^<]*)</data>'
            there = F.col("value").rlike(pattern)
            return F.when(there, _unescaped(F.regexp_extract("value", pattern, 1))).cast(f.dataType).alias(f.name)

        return line.select(*[column(f) for f in schema.fields])

    vertices = read("nodes", like.vertices.schema, {"id": "id"})
    return Graph(vertices, read("edges", like.edges.schema, {"id": "id", "src": "source", "dst": "target"}))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


__all__ = [
    "META", "Dump", "read_dump", "read_graph", "read_graphml", "read_whole_dump", "read_incremental", "read_log", "write_dump", "write_graph", "write_graphml",
    "write_incremental", "write_log", "write_table",
]
