"""Service areas: the parts of edges within a distance, by closed form from the labels of the edges' ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.runtime import shuffled


def service_area(labels: DataFrame, edges: DataFrame, limit: float, whole: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(o, edge_id, vector): vector is the covered fraction, positive from the edge's start, negative from its end, 1 or -1 the whole edge.

    whole: (o, edge_id) of edges that count as whole, those of the origins. nodes: their costs decide whether the far end is
    reached. An edge covered from both ends, though not whole, has two rows."""
    near = labels.where(F.col("dist") <= limit)
    ends = edges.select("edge_id", "len", "len_r", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("side")), F.struct(F.col("v").alias("node"), F.lit(-1).alias("side")))).alias("s"), "u", "v")
    ends = ends.select("edge_id", "s.node", "s.side", F.when(F.col("s.side") == 1, F.col("len")).otherwise(F.col("len_r")).alias("len"), F.when(F.col("s.side") == 1, F.col("v")).otherwise(F.col("u")).alias("far"))
    hit = near.join(shuffled(ends), "node")
    if nodes is not None:
        hit = hit.join(shuffled(nodes.where("cost <> 0").select(F.col("node_id").alias("far"), F.col("cost").alias("far_cost"))), "far", "left")
    else:
        hit = hit.withColumn("far_cost", F.lit(0.0))
    left = F.lit(float(limit)) - F.col("dist")
    f = F.when(F.col("len") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("len")))).otherwise(F.lit(1.0))
    full = left - F.coalesce("far_cost", F.lit(0.0)) >= F.col("len")
    both = hit.groupBy("o", "edge_id").agg(*[F.max(F.when(F.col("side") == s, x)).alias(n) for s, x, n in ((1, f, "fu"), (-1, f, "fv"), (1, full, "wu"), (-1, full, "wv"))])
    if whole is not None:
        both = both.join(whole.distinct().withColumn("own", F.lit(True)), ["o", "edge_id"], "full")
    else:
        both = both.withColumn("own", F.lit(False))
    fu, fv = F.coalesce("fu", F.lit(0.0)), F.coalesce("fv", F.lit(0.0))
    is_whole = F.coalesce("own", F.lit(False)) | F.coalesce("wu", F.lit(False)) | F.coalesce("wv", F.lit(False)) | (fu + fv > 1)
    sign = F.when(F.col("fu").isNotNull() | F.col("fv").isNull(), F.lit(1.0)).otherwise(F.lit(-1.0))
    parts = F.filter(F.array(F.when(fu > 0, fu), F.when(fv > 0, -fv)), lambda x: x.isNotNull())
    return both.select("o", "edge_id", F.explode(F.when(is_whole, F.array(sign)).otherwise(parts)).alias("vector"))


def area_geometry(area: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds geom, the covered part of the edge."""
    return area.join(shuffled(edges.select("edge_id", "geom")), "edge_id").withColumn("geom", G.part_by_vector(F.col("geom"), F.col("vector")))


def node_reach(labels: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """(o, node_id, dist, x, y) of nodes within `limit`."""
    return labels.where(F.col("dist") <= limit).join(shuffled(nodes.select(F.col("node_id").alias("node"), "x", "y")), "node").select("o", F.col("node").alias("node_id"), "dist", "x", "y")
