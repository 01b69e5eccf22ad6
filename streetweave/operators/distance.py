"""Bounded shortest distances, for all origins at once, by frontier expansion.

labels: (o, node, dist), the least distance from origin o to a node within a limit. Each round joins the labels that just
improved with the arcs, keeps the least candidate for each (o, node) by partial and final aggregation, and merges it into
the labels; the loop ends when nothing improves, after at most as many rounds as a path has edges. Arcs are broadcast only
if they are few; beyond that the join shuffles by node. Every round is checkpointed in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.operators.build import arcs as make_arcs
from streetweave.runtime import cut, maybe_broadcast, shuffled

#: Rounds after which a loop is taken to be astray; it raises, and never returns less.
MAX_ROUNDS = 10_000


def weighted_arcs(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, edge_id, cost: an edge's cost and that of the node it enters."""
    a = make_arcs(edges)
    if nodes is None:
        return a
    c = nodes.where("cost <> 0").select(F.col("node_id").alias("dst"), F.col("cost").alias("node_cost"))
    return a.join(shuffled(c), "dst", "left").select("src", "dst", "edge_id", (F.col("cost") + F.coalesce("node_cost", F.lit(0.0))).alias("cost"))


def bounded_labels(arcs: DataFrame, seeds: DataFrame, limit: float, reverse: bool = False) -> DataFrame:
    """seeds (o, node, dist), which the limit doesn't bind -> (o, node, dist) of all nodes within `limit`. reverse: distances to the seeds."""
    a = arcs.select(F.col("dst").alias("node"), F.col("src").alias("to"), "cost") if reverse else arcs.select(F.col("src").alias("node"), F.col("dst").alias("to"), "cost")
    a = maybe_broadcast(cut(a.groupBy("node", "to").agg(F.min("cost").alias("cost"))))
    labels = cut(seeds.groupBy("o", "node").agg(F.min("dist").alias("dist")).withColumn("fresh", F.lit(True)))
    for _ in range(MAX_ROUNDS):
        found = labels.where("fresh").join(a, "node").select("o", F.col("to").alias("node"), (F.col("dist") + F.col("cost")).alias("nd")).where(F.col("nd") <= limit)
        found = found.groupBy("o", "node").agg(F.min("nd").alias("nd"))
        merged = labels.select("o", "node", "dist").join(found, ["o", "node"], "full")
        better = F.col("nd").isNotNull() & (F.col("dist").isNull() | (F.col("nd") < F.col("dist")))
        labels = cut(merged.select("o", "node", F.least("dist", "nd").alias("dist"), better.alias("fresh")))
        if labels.where("fresh").isEmpty():
            return labels.select("o", "node", "dist")
    raise RuntimeError("the network has paths of more edges than MAX_ROUNDS")


def entry_seeds(entries: DataFrame, together: bool = False) -> DataFrame:
    """Both ends of each snapped entry's edge, with the distance along it. together: all entries as one origin."""
    o = F.lit(0).cast("long") if together else F.col("entry_id")
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("pos_o").alias("dist")), F.struct(F.col("v").alias("node"), F.col("pos_d").alias("dist")))
    return entries.select(o.alias("o"), F.explode(ends).alias("s")).select("o", "s.node", "s.dist")


def with_ends(snapped: DataFrame, edges: DataFrame) -> DataFrame:
    """Snapped entries with u and v of their edge; entries without an edge go."""
    return snapped.join(shuffled(edges.select("edge_id", "u", "v")), "edge_id")


def od_distances(labels: DataFrame, origins: DataFrame, dests: DataFrame, limit: float, gate: float = 1.1) -> DataFrame:
    """(o, d, pth, fly, same_edge) of origins and destinations (with_ends) that labels connect within `limit`.

    fly: straight distance of the snapped points, 0.1 if zero; pairs with gate * fly > limit are left out. Entries on one edge
    are at their distance along it (0.1 if zero), whatever the limit. Destinations meet the labels at each of their
    edge's ends in an equi-join, and the nearer end is taken by aggregation."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("pos_o").alias("off")), F.struct(F.col("v").alias("node"), F.col("pos_d").alias("off")))
    access = dests.select(F.col("entry_id").alias("d"), F.explode(ends).alias("s")).select("d", "s.node", "s.off")
    net = labels.join(access, "node").groupBy("o", "d").agg(F.min(F.col("dist") + F.col("off")).alias("pth"))
    at_o = origins.select(F.col("entry_id").alias("o"), F.col("edge_id").alias("oe"), F.col("pos_o").alias("op"), F.col("ix").alias("ox"), F.col("iy").alias("oy"))
    at_d = dests.select(F.col("entry_id").alias("d"), F.col("edge_id").alias("de"), F.col("pos_o").alias("dp"), F.col("ix").alias("dx"), F.col("iy").alias("dy"))
    far = net.where(F.col("pth") <= limit).join(at_o, "o").join(at_d, "d").where("oe <> de").withColumn("same_edge", F.lit(False))
    near = at_o.join(at_d, at_o["oe"] == at_d["de"]).withColumn("pth", F.abs(F.col("op") - F.col("dp"))).withColumn("same_edge", F.lit(True))
    near = near.withColumn("pth", F.when(F.col("pth") == 0, F.lit(0.1)).otherwise(F.col("pth")))
    both = far.unionByName(near).where("o <> d").withColumn("fly", G.euclid("ox", "oy", "dx", "dy"))
    both = both.where(F.col("fly") * gate <= limit)
    return both.select("o", "d", "pth", F.when(F.col("fly") == 0, F.lit(0.1)).otherwise(F.col("fly")).alias("fly"), "same_edge")


def node_distances(arcs: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """sources (node_id) -> (o, node, dist) of nodes within `limit`, the sources themselves at 0."""
    return bounded_labels(arcs, sources.select(F.col("node_id").alias("o"), F.col("node_id").alias("node"), F.lit(0.0).alias("dist")), limit)


def node_paths(arcs: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """pairs (src, dst) -> (src, dst, length, edges): the shortest path of each pair within `limit`, ties by the edges' ids.

    The labels' least struct carries the path, whose length is bounded by the rounds."""
    a = maybe_broadcast(cut(arcs.select(F.col("src").alias("node"), F.col("dst").alias("to"), "edge_id", "cost")))
    seeds = pairs.select(F.col("src").alias("o")).distinct()
    labels = cut(seeds.select("o", F.col("o").alias("node"), F.struct(F.lit(0.0).alias("dist"), F.array().cast("array<bigint>").alias("edges")).alias("b"), F.lit(True).alias("fresh")))
    for _ in range(MAX_ROUNDS):
        step = F.struct((F.col("b.dist") + F.col("cost")).alias("dist"), F.concat("b.edges", F.array(F.col("edge_id").cast("long"))).alias("edges"))
        found = labels.where("fresh").join(a, "node").select("o", F.col("to").alias("node"), step.alias("nb")).where(F.col("nb.dist") <= limit)
        found = found.groupBy("o", "node").agg(F.min("nb").alias("nb"))
        merged = labels.select("o", "node", "b").join(found, ["o", "node"], "full")
        better = F.col("nb").isNotNull() & (F.col("b").isNull() | (F.col("nb") < F.col("b")))
        labels = cut(merged.select("o", "node", F.when(better, F.col("nb")).otherwise(F.col("b")).alias("b"), better.alias("fresh")))
        if labels.where("fresh").isEmpty():
            hit = pairs.select("src", "dst").distinct().join(shuffled(labels), (F.col("src") == F.col("o")) & (F.col("dst") == F.col("node")))
            return hit.select("src", "dst", F.col("b.dist").alias("length"), F.col("b.edges").alias("edges"))
    raise RuntimeError("the network has paths of more edges than MAX_ROUNDS")
