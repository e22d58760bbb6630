"""Chat formatting: paths through reply trees, each formatted as one conversation.

Messages name the message they answer. Root-to-leaf paths come from iterative self-joins that
double in length each round, so a thread of n messages takes log2(n) rounds. Branches are ranked by
their score; each chosen path becomes one text with the spans of the assistant's words beside it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string can stand inside a text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (begin, end) of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def masked_text(formatted: str, spans) -> str:
    """What the loss mask covers, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``tree, path, pos, node``: the ``keep`` best root-to-leaf paths of each reply tree.

    ``messages`` has ``node`` (unique), ``parent`` (null at a root) and ``score`` (null counts as
    0). A path's rank is by its summed score, then its length, both descending, then its leaf; the
    leaf names the path and the root the tree. A parent that is not there makes its children
    roots. Messages on a cycle have no root and are left out. An empty table has no paths.
    """
    m = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = m.select(F.col("node").alias("parent"))
    m = m.join(nodes.withColumn("__there", F.lit(True)), "parent", "left")
    m = materialize(m.select("node", F.when(F.col("__there"), F.col("parent")).alias("parent"), "score"))
    # jumps[k]: the ancestor 2**k above, while there is one
    jumps = [m.filter("parent is not null").select("node", F.col("parent").alias("up"))]
    total = m.count()
    while (1 << len(jumps)) <= total:
        last = jumps[-1]
        upper = last.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = materialize(last.join(upper, "up").select("node", F.col("next").alias("up")))
        if step.isEmpty():
            break
        jumps.append(step)
    inner = m.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = m.join(inner, "node", "left_anti")
    paths = leaves.select(F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        more = paths.join(jumps[k], "node").select("path", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = paths.unionByName(more)
        if k % 4 == 0:
            paths = materialize(paths)
    paths = materialize(paths.join(m, "node"))
    ranked = paths.groupBy("path").agg(
        F.sum("score").alias("total"), F.count(F.lit(1)).alias("size"),
        F.max(F.when(F.col("parent").isNull(), F.col("node"))).alias("tree"),
    )
    ranked = ranked.filter("tree is not null")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("size"), "path")
    chosen = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    return paths.join(chosen.select("path", "tree", "size"), "path").select(
        "tree", "path", (F.col("size") - 1 - F.col("back")).alias("pos"), "node"
    )


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """``path, formatted, loss_spans``: each path as one conversation.

    ``messages`` has ``node, role, text``; null roles and texts count as empty. ``loss_spans``
    are code point ranges of the assistant's texts in ``formatted``.
    """
    turns = paths.select("path", "pos", "node").join(messages.select("node", "role", "text"), "node")
    empty = F.lit("")
    one = F.struct("pos", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [format_turns([(t["role"], t["text"]) for t in row]) for row in part.column(1).to_pylist()]
                spans = [[{"begin": a, "end": b} for a, b in s] for _, s in done]
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)],
                    ["path", "formatted", "loss_spans"],
                )

    return grouped.select("path", "turns").mapInArrow(
        run, "path string, formatted string, loss_spans array<struct<begin:long,end:long>>"
    )


def linear_messages(conversations: DataFrame) -> DataFrame:
    """``conv_id, node, parent, score, role, text`` of plain conversations: each turn answers the last.

    Turns are ordered by ``turn``, ties by role and text; repeated rows are turns of their own.
    """
    c = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    c = c.withColumn("n", F.row_number().over(w))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.concat(name, F.lit(":"), F.col("n").cast("string"))
    parent = F.when(F.col("n") > 1, F.concat(name, F.lit(":"), (F.col("n") - 1).cast("string")))
    return c.select("conv_id", node.alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation, by way of its reply tree.

    Null texts and roles count as empty; a null conversation id is a conversation of its own; other
    columns are ignored; an empty table gives an empty result.
    """
    messages = materialize(linear_messages(conversations))
    done = format_paths(reply_paths(messages), messages)
    owner = messages.select(F.col("node").alias("path"), "conv_id")
    return done.join(owner, "path").select("conv_id", "formatted", "loss_spans")
