"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _ordered(edges: DataFrame, a, b) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) -> node, component (least node reachable) for every node with an
    edge, as a table of ``scratch``.

    In each level a node takes its least neighbour (or itself) as label, by
    minima that are aggregated before the shuffle, and edges are rewritten to
    labels; every node meets another, so few levels remain even for chains.
    The neighbours of a node are never brought together: a node with very many
    edges is a skewed join key, which Spark splits."""
    cur = scratch.keep(_ordered(edges, F.col("a"), F.col("b")))
    levels: list[DataFrame] = []
    while not levels or not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
        levels.append(label)
        of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"{x}{x}"))  # noqa: E731, B023
        rest = scratch.keep(_ordered(cur.join(of("a"), "a").join(of("b"), "b"), F.col("aa"), F.col("bb")))
        scratch.drop(cur)
        cur = rest
    out = levels[0]
    for label in levels[1:]:
        label = label.select(F.col("node").alias("component"), F.col("component").alias("c"))
        out = out.join(label, "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    out = scratch.keep(out)
    scratch.drop(cur, *levels)
    return out
