"""All alternative routes between entries within a detour ratio, for all pairs at once.

Routes are rows that grow from the destination towards the origin. Each round joins the open routes with the arcs that enter
their node and with the origin's labels, and keeps those that can still end within the limit and use no edge twice; a route
that can step onto the origin's edge is complete. Nothing is cut short: if more rows are open than `max_open`, it raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetweave.operators.distance import MAX_ROUNDS, bounded_labels, od_distances
from streetweave.runtime import cut, maybe_broadcast, shuffled

EPS = 1 + 1e-9


def enumerate_paths(arcs: DataFrame, labels: DataFrame, origins: DataFrame, dests: DataFrame, limit: float, detour: float = 1.0, monotone: bool = True, path_limit: int | None = None, gate: float = 1.1, max_open: int = 200_000_000) -> DataFrame:
    """(o, d, length, edges): edges of a route from o to d, the first and last one whole.

    labels: bounded_labels of the origins up to limit * detour. monotone: the distance from the origin may not rise on the way
    back to it. path_limit: routes kept for a pair, the shortest, then by their edges."""
    od = cut(od_distances(labels, origins, dests, limit, gate))
    at_o = origins.select(F.col("entry_id").alias("o"), F.col("edge_id").alias("oe"))
    ends_o = origins.select(F.col("entry_id").alias("o"), F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("pos_o").alias("off")), F.struct(F.col("v").alias("node"), F.col("pos_d").alias("off")))).alias("s")).select("o", "s.node", "s.off")
    ends_d = dests.select(F.col("entry_id").alias("d"), F.col("edge_id").alias("de"), F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("pos_o").alias("len")), F.struct(F.col("v").alias("node"), F.col("pos_d").alias("len")))).alias("s")).select("d", "de", "s.node", "s.len")
    same = od.where("same_edge").join(at_o, "o").select("o", "d", F.col("pth").alias("length"), F.array(F.col("oe").cast("long")).alias("edges"))
    into = maybe_broadcast(cut(arcs.select(F.col("dst").alias("node"), F.col("src").alias("back"), "edge_id", "cost")))
    lab = cut(labels)
    open_ = od.where("NOT same_edge").join(at_o, "o").select("o", "d", "oe", (F.col("pth") * detour * EPS).alias("lim")).join(ends_d, "d")
    open_ = open_.join(lab.withColumnRenamed("dist", "lab"), ["o", "node"]).where(F.col("len") + F.col("lab") <= F.col("lim"))
    open_ = cut(open_.select("o", "d", "oe", "lim", "node", "len", "lab", F.array(F.col("de").cast("long")).alias("edges")))
    done = same
    for k in range(MAX_ROUNDS):
        n = open_.count()
        if n == 0:
            break
        if n > max_open:
            raise RuntimeError(f"{n} routes are open; lower the limit or the detour ratio, or raise max_open")
        closed = open_.join(ends_o, ["o", "node"]).where(~F.array_contains("edges", F.col("oe").cast("long")))
        closed = closed.select("o", "d", (F.col("len") + F.col("off")).alias("length"), F.concat("edges", F.array(F.col("oe").cast("long"))).alias("edges"), "lim").where(F.col("length") <= F.col("lim"))
        # Complete routes are worked out together at the end, from the checkpoints of their rounds.
        done = done.unionByName(closed.select("o", "d", "length", F.reverse("edges").alias("edges")))
        if k % 16 == 15:
            done = cut(done)
        step = open_.join(into, "node").where((F.col("edge_id") != F.col("oe")) & ~F.array_contains("edges", F.col("edge_id").cast("long")))
        step = step.select("o", "d", "oe", "lim", F.col("back").alias("node"), (F.col("len") + F.col("cost")).alias("len"), F.col("lab").alias("last"), F.concat("edges", F.array(F.col("edge_id").cast("long"))).alias("edges"))
        step = step.join(lab.withColumnRenamed("dist", "lab"), ["o", "node"]).where(F.col("len") + F.col("lab") <= F.col("lim"))
        if monotone:
            step = step.where(F.col("lab") <= F.col("last"))
        open_ = cut(step.drop("last"))
    if path_limit is not None:
        w = Window.partitionBy("o", "d").orderBy("length", "edges")
        done = done.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= path_limit).drop("_k")
    return done


def enumerate_node_paths(arcs: DataFrame, pairs: DataFrame, limit: float, detour: float = 1.1, path_limit: int | None = None, max_open: int = 200_000_000) -> DataFrame:
    """pairs (src, dst) -> (src, dst, length, edges): all routes that use no edge twice, end where they first meet dst and are at most
    detour times the shortest one long; none if that is beyond `limit`. A node's route to itself has length 0 and no edges.

    Distances to all destinations come from one expansion against the arcs; routes then grow from src and keep to what can still arrive."""
    wanted = cut(pairs.select("src", "dst").distinct())
    goals = wanted.select(F.col("dst").alias("o"), F.col("dst").alias("node"), F.lit(0.0).alias("dist")).distinct()
    left = cut(bounded_labels(arcs, goals, limit * detour * EPS, reverse=True).select(F.col("o").alias("dst"), "node", F.col("dist").alias("left")))
    out = maybe_broadcast(cut(arcs.select(F.col("src").alias("node"), F.col("dst").alias("to"), "edge_id", "cost")))
    best = left.withColumnRenamed("node", "src").where(F.col("left") <= limit)
    start = wanted.join(shuffled(best), ["src", "dst"]).select("src", "dst", (F.col("left") * detour * EPS).alias("lim"), F.col("src").alias("node"), F.lit(0.0).alias("len"), F.array().cast("array<bigint>").alias("edges"))
    start = cut(start)
    done = start.where("node = dst").select("src", "dst", F.col("len").alias("length"), "edges")
    open_ = start.where("node <> dst")
    for k in range(MAX_ROUNDS):
        n = open_.count()
        if n == 0:
            break
        if n > max_open:
            raise RuntimeError(f"{n} routes are open; lower the limit or the detour ratio, or raise max_open")
        step = open_.join(out, "node").where(~F.array_contains("edges", F.col("edge_id").cast("long")))
        step = step.select("src", "dst", "lim", F.col("to").alias("node"), (F.col("len") + F.col("cost")).alias("len"), F.concat("edges", F.array(F.col("edge_id").cast("long"))).alias("edges"))
        step = cut(step.join(left, ["dst", "node"]).where(F.col("len") + F.col("left") <= F.col("lim")).drop("left"))
        done = done.unionByName(step.where("node = dst").select("src", "dst", F.col("len").alias("length"), "edges"))
        if k % 16 == 15:
            done = cut(done)
        open_ = step.where("node <> dst")
    else:
        raise RuntimeError("routes have more edges than MAX_ROUNDS")
    if path_limit is not None:
        w = Window.partitionBy("src", "dst").orderBy("length", "edges")
        done = done.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= path_limit).drop("_k")
    return done
