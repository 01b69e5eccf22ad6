"""Joins are dealt out by rows that were counted, not by Spark's estimates of size, which start from files and miss what explode adds."""

import pytest
from pyspark.sql import functions as F

from streetweave import runtime
from streetweave.operators import build, distance, paths, prepare, snap
from streetweave.plans import catalogue, network

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "entry_snap",
    "add_nodes",
    "change_entries",
    "node_removed_graph",
    "node_path_edges",
    "dead_end_lines",
    "bbox_overlap_pairs",
    "net_nodes_junctions",
    "junction_layer",
    "attribute_layer",
    "node_shortest_distance",
    "betweenness_plural",
    "betweenness_true_paths",
    "node_distance_3d",
    "colour_ramp",
    "explode_multilines",
    "extend_lines",
    "flatten_lines",
    "geojson_round_trip",
    "hex_colour",
    "ids_when_absent",
    "junction_compile",
    "line_points",
    "net_dead_end_ratio",
    "net_build_edges",
    "node_shortest_path",
    "service_area_length",
    "service_area_nodes",
    "service_area_from_node",
    "segment_intersections",
    "edge_removed_graph",
    "smallest_missing_id",
    "node_routes",
    "touch_points",
    "split_at_points",
    "build_with_tolerance",
]


@pytest.fixture(scope="module")
def plans(spark):
    """The plans of all tables cut so far, as if more rows than are broadcast were counted, in a session that broadcasts what it estimates as small.
    The network is built once; its plans count for all queries."""
    seen, patch = [], pytest.MonkeyPatch()

    def cut(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return runtime.cut(df)

    for module in (build, catalogue, distance, network, paths, prepare, snap):
        if hasattr(module, "cut"):
            patch.setattr(module, "cut", cut)
    patch.setattr(runtime, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    catalogue.forget()
    yield seen
    patch.undo()
    catalogue.forget()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def broadcasts(seen, df):
    """Lines of the plans with a broadcast join, but for the numbering of rows, which broadcasts a row for each partition."""
    plans = (*seen, df._jdf.queryExecution().executedPlan().toString())
    return [x for p in plans for x in p.splitlines() if ("BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x) and "[_part#" not in x]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_broadcast_by_estimate(spark, plans, name):
    assert broadcasts(plans, catalogue.QUERIES[name](spark, SMALL)) == []
    assert len(plans) >= 3


def test_few_rows_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    few = spark.range(3).select(F.col("id").alias("k"))
    join = lambda d: spark.range(9).join(runtime.maybe_broadcast(d), F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in join(few)
    assert "BroadcastHashJoin" not in join(few.unionByName(few))
