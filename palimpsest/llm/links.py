"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id that the links (``a``, ``b``) name; the least id names it.

    Each round every node points at its least neighbour, pointers are followed to their roots by
    doubling, and the graph shrinks to its roots. Nothing comes to the driver but whether a round
    has links left. Links of a node with itself are ignored; so are repeated links and nulls.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(links.select("a", "b").dropna().select(*edges.columns).filter("a <> b").distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p"))
        up = materialize(up)
        while True:
            above = up.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(up.join(above, "p").select("id", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            up = jumped.select("id", "p")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = up.select("id", F.col("p").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), "p")
            found = found.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        found = materialize(found)
        a, b = up.select(F.col("id").alias("a"), F.col("p").alias("pa")), up.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(a, "a").join(b, "b").filter("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
