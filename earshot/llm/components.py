"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long) to ``node, component``; the component is its smallest node.

    Every round each node takes the first of itself and its neighbours in the order of a hash, edges
    are renamed, loops and repeated edges go. The random order makes the graph shrink by a factor a
    round whatever its shape, long chains too. Each round is written to the shared folder and holds the
    nodes that still had edges; the last round's names are carried back through the rounds before, so all
    rounds together cost in proportion to the nodes. Null ends are left out; no edges: no rows.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = settle(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = settle(
            both.groupBy("a").agg(F.min(F.least(order("a"), order("b"))).alias("m")).select(F.col("a").alias("c"), F.col("m.v").alias("to")), "stars"
        )
        renamed = left.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
        left = settle(renamed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        rounds.append(first)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = rounds.pop().toDF("node", "c")
    for first in reversed(rounds):
        names = settle(first.toDF("node", "to").join(names.toDF("to", "c"), "to", "left").select("node", F.coalesce("c", "to").alias("c")), "nodes")
    least = names.groupBy("c").agg(F.min("node").alias("component"))
    return names.join(least, "c").select("node", "component")
