"""Connected components of a graph of edges, by contraction, in DataFrame steps.

Every node has a fixed random priority. In a round each node moves to the neighbour (or itself) of
lowest priority, and edges between nodes that moved together go; a star falls into one node in two
rounds, a path halves in each. The moves are then followed back. Rounds aggregate and join by node, so
nodes of many edges are partly aggregated or split by adaptive execution; nothing is gathered on the
driver but row counts. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import discard, materialise


def _priority(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), c.alias("id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, in any direction, repeats and loops allowed -> (node, root): the same root for all nodes that edges
    connect; root is one of them. Nodes without an edge to another one may be missing."""
    e = materialise(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    moves = []
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
        best = both.groupBy("node").agg(F.min(_priority(F.col("other"))).alias("best"))
        own = _priority(F.col("node"))
        moved = materialise(best.select("node", F.when(F.col("best") < own, F.col("best.id")).otherwise(F.col("node")).alias("to")), "cc-moves")
        moves.append(moved)
        at_a = moved.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        at_b = moved.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        nxt = e.join(at_a, "a").join(at_b, "b").where("to_a <> to_b")
        nxt = materialise(nxt.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")
        discard(e)
        e = nxt
        if e.isEmpty():
            break
    roots = moves[-1].select("node", F.col("to").alias("root"))
    for moved in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = moved.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def smallest_member(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (node, id) and connected_components' roots -> (node, root, smallest): of ids in the node's component.

    root is the node itself for nodes without edges."""
    at = members.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    at = materialise(at, "cc-members")
    least = at.groupBy("root").agg(F.min("id").alias("smallest"))
    return at.select("node", "root").distinct().join(least, "root")
