"""Entries snapped to the nearest edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.operators.prepare import nearby_segments, segment_rows
from streetweave.runtime import shuffled


def snap_entries(entries: DataFrame, edges: DataFrame, reach: float = 100.0, edge_cost: str | None = None) -> DataFrame:
    """entries (entry_id, x, y, ...) with edge_id, snap_dist, pos_o, pos_d (distances along the line from its start and to its end),
    ix, iy, edge_cost. Nearest within `reach`, then the smaller edge_id and segment; farther entries have null edge_id.

    One aggregation picks the nearest of a point's candidates, so no window sorts them."""
    p = entries.select("entry_id", F.col("x").alias("px"), F.col("y").alias("py"))
    near = nearby_segments(p, segment_rows(edges), reach)
    best = near.groupBy("entry_id").agg(F.min(F.struct("dist", "edge_id", "seg", (F.col("at") + F.col("t") * F.col("len")).alias("pos"), "ix", "iy")).alias("b"))
    own = edges.select("edge_id", G.length(F.col("geom")).alias("total"), (F.col(edge_cost).cast("double") if edge_cost else F.lit(0.0)).alias("edge_cost"))
    b = best.select("entry_id", "b.edge_id", F.col("b.dist").alias("snap_dist"), F.col("b.pos").alias("pos_o"), "b.ix", "b.iy").join(shuffled(own), "edge_id")
    b = b.select("entry_id", "edge_id", "snap_dist", "pos_o", (F.col("total") - F.col("pos_o")).alias("pos_d"), "ix", "iy", "edge_cost")
    return entries.join(shuffled(b), "entry_id", "left")


def mapped(snapped: DataFrame) -> DataFrame:
    return snapped.where(F.col("edge_id").isNotNull())
