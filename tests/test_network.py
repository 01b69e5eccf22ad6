"""Micro-networks with values worked out by hand, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.functions import style, timeprofile
from streetweave.operators import build, distance, metrics, paths, prepare, snap
from streetweave.plans.network import SpatialNetwork
from streetweave.plans.options import BetweennessBatchOptions, BetweennessOptions, ReachBatchOptions, ReachOptions, SessionOptions, StraightnessOptions

LINES = "edge_id long, geom array<struct<x:double,y:double>>"


def lines(spark, *geoms):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in g]) for i, g in enumerate(geoms)], LINES)


def entries(spark, *rows):
    """(x, y, weight[, category]), numbered from 0."""
    return spark.createDataFrame([(i, float(r[0]), float(r[1]), float(r[2]), r[3] if len(r) > 3 else "k") for i, r in enumerate(rows)], "entry_id long, x double, y double, weight double, category string")


@pytest.fixture(scope="module")
def path(spark):
    net = lines(spark, [(0, 0), (100, 0)], [(100, 0), (200, 0)], [(200, 0), (300, 0)])
    return SpatialNetwork.from_lines(net, entries(spark, (50, 0, 1, "a"), (150, 0, 2, "b"), (250, 0, 3, "b")))


@pytest.fixture(scope="module")
def square(spark):
    net = lines(spark, [(0, 0), (100, 0)], [(100, 0), (100, 100)], [(100, 100), (0, 100)], [(0, 100), (0, 0)])
    return SpatialNetwork.from_lines(net, entries(spark, (50, 100, 10), (50, 0, 1)))


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_od_on_a_path(path):
    od = {(r.o, r.d): r.pth for r in path.od(limit=250.0).collect()}
    assert od == {(0, 1): 100, (1, 0): 100, (0, 2): 200, (2, 0): 200, (1, 2): 100, (2, 1): 100}
    assert {r.r for r in path.reach(options=ReachOptions(limit=250.0)).collect()} == {2}
    assert {k: r.r for k, r in rows(path.reach(options=ReachOptions(limit=150.0)), "o").items()} == {0: 1, 1: 2, 2: 1}
    w = rows(path.reach(mode="NDW", options=ReachOptions(limit=250.0)), "o")[0]
    assert (w.r, w.r_d, w.r_w) == (2, 100.0, 5.0)


@pytest.mark.parametrize(("exponent", "want"), [(0.0, 1.56), (-0.35, 1.3153), (0.35, 2.9498)])
def test_decayed_reach(path, exponent, want):
    r = rows(path.reach(mode="WD", options=ReachOptions(limit=250.0, exponent=exponent)), "o")
    assert r[0].r_w == pytest.approx(want, abs=1e-4)


def test_straightness(path, square):
    assert {r.straightness for r in path.straightness().collect()} == {1.0}
    assert {r.straightness for r in square.straightness(options=StraightnessOptions(limit=300.0, exponent=0.0)).collect()} == {0.5}


def test_reach_columns_fill_with_zero(path):
    out = rows(path.reach_column([0], [1], "ND", ReachOptions(limit=250.0)), "entry_id")
    assert (out[0].Reach, out[0].Reach_W, out[1].Reach, out[2].Reach_W) == (1, 100.0, 0, 0)


def test_unknown_mode(path):
    with pytest.raises(ValueError, match="mode"):
        path.reach(mode="X")


def test_betweenness_on_a_path(spark):
    net = lines(spark, [(0, 0), (100, 0)], [(100, 0), (200, 0)], [(200, 0), (300, 0)])
    n = SpatialNetwork.from_lines(net, entries(spark, (50, 0, 10), (150, 0, 2), (250, 0, 3)))
    edge, dest = n.betweenness([0], [1, 2], BetweennessOptions(limit=250.0), destinations=True)
    assert {k: round(r.betweenness, 4) for k, r in rows(edge, "edge_id").items()} == {0: 10, 1: 10, 2: 4.2857}
    assert {k: round(r.patronage, 4) for k, r in rows(dest, "d").items()} == {1: 5.7143, 2: 4.2857}


@pytest.mark.parametrize("kw", [{}, {"true_paths": True}, {"singular": True}])
def test_both_ways_round_a_square(square, kw):
    routes = {tuple(r.edges): r.length for r in square.routes([0], [1], BetweennessOptions(limit=300.0, **kw)).collect()}
    assert routes == {(2, 3, 0): 200, (2, 1, 0): 200}
    b = rows(square.betweenness([0], [1], BetweennessOptions(limit=300.0, **kw)), "edge_id")
    assert {k: r.betweenness for k, r in b.items()} == {0: 10, 2: 10, 1: 5, 3: 5}
    assert square.routes([0], [1], BetweennessOptions(limit=300.0, path_limit=1, **kw)).count() == 1


@pytest.mark.parametrize(
    ("limit", "want"),
    [
        (120.0, {(2, 1.0), (1, -0.7), (3, 0.7)}),
        (180.0, {(2, 1.0), (1, 1.0), (3, 1.0), (0, 0.3), (0, -0.3)}),
        (201.0, {(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)}),
    ],
)
def test_service_area(square, limit, want):
    got = [(r.edge_id, round(r.vector, 6)) for r in square.service_area([0], limit).collect()]
    sign = lambda v: abs(v) if abs(v) == 1 else v
    assert {(e, sign(v)) for e, v in got} == want and len(got) == len(want)


def test_service_geometry_and_nodes(square):
    area = square.service_area([0], 180.0, geometry=True).withColumn("n", G.length(F.col("geom")))
    assert area.agg(F.sum("n")).first()[0] == pytest.approx(360)
    joined = square.service_area(limit=100.0, joined=True)
    assert {abs(r.vector) for r in joined.where("edge_id IN (0, 2)").collect()} == {1.0}
    near = square.service_nodes([0], 160.0).collect()
    assert sorted(r.dist for r in near) == [50, 50, 150, 150] and square.service_nodes([0], 149.0).count() == 2


def test_same_edge_and_gate(spark):
    one = lines(spark, [(0, 0), (100, 0)])
    n = SpatialNetwork.from_lines(one, entries(spark, (20, 0, 1), (80, 0, 1), (80, 5, 1)))
    od = {(r.o, r.d): (r.pth, r.fly) for r in n.od(limit=300.0).collect()}
    assert od[0, 1] == (60, 60) and od[1, 2] == (0.1, 0.1)
    far = lines(spark, [(0, 0), (48, 11)], [(48, 11), (95, 0)])
    m = SpatialNetwork.from_lines(far, entries(spark, (0, 0, 1), (95, 0, 1)))
    assert m.od(limit=100.0).count() == 0 and m.od(limit=105.0).count() == 2


def test_entries_out_of_reach_and_parts(spark):
    net = lines(spark, [(0, 0), (100, 0)], [(1000, 0), (1100, 0)])
    n = SpatialNetwork.from_lines(net, entries(spark, (50, 0, 1), (50, 150, 1), (1050, 0, 1)))
    assert [r.edge_id for r in n.entries.orderBy("entry_id").collect()] == [0, None, 1]
    assert n.od(limit=5000.0).count() == 0
    assert n.size_info().first().asDict() == {"n_nodes": 4, "n_edges": 2, "n_entries": 2}


def test_many_arcs_at_a_node(spark):
    spokes = [[(0, 0), (100 * math.cos(i), 100 * math.sin(i))] for i in range(12)]
    n = SpatialNetwork.from_lines(lines(spark, *spokes), entries(spark, *[(90 * math.cos(i), 90 * math.sin(i), 1) for i in range(12)]))
    assert {r.r for r in n.reach(options=ReachOptions(limit=400.0)).collect()} == {11}
    assert rows(n.junctions(), "node_id")[0].junct_cnt == 12


def test_directed_lengths_and_node_costs(spark):
    base = [(0, [(0.0, 0.0), (100.0, 0.0)], 100.0, 200.0), (1, [(100.0, 0.0), (200.0, 0.0)], 100.0, 200.0), (2, [(200.0, 0.0), (300.0, 0.0)], 100.0, 200.0)]
    net = spark.createDataFrame(base, LINES + ", there double, back double")
    e = entries(spark, (50, 0, 1), (150, 0, 1), (250, 0, 1))
    n = SpatialNetwork.from_lines(net, e, SessionOptions(len_col="there", len_r_col="back"))
    od = {(r.o, r.d): r.pth for r in n.od(limit=1000.0).collect()}
    assert od[0, 2] == 200 and od[2, 0] == 300
    m = SpatialNetwork.from_lines(net.select("edge_id", "geom"), e)
    costly = SpatialNetwork(m.nodes.withColumn("cost", F.when(F.col("x").isin(100.0, 200.0), 10.0).otherwise(0.0)), m.edges, m.entries)
    assert {(r.o, r.d): r.pth for r in costly.od(limit=1000.0).collect()}[0, 2] == 210


def test_faults_are_named_together(spark):
    with pytest.raises(ValueError, match="x and y.*projections.*nothing"):
        SpatialNetwork.from_lines(lines(spark, [(0, 0), (1, 0)]), spark.range(1), SessionOptions(len_col="nothing"), 32748, 23830)
    bad = lines(spark, [(0, 0), (1, 0)]).withColumn("n", F.lit(-1.0))
    with pytest.raises(ValueError, match="zero or more"):
        SpatialNetwork.from_lines(bad, entries(spark, (0, 0, 1)), SessionOptions(len_col="n"))


def test_crossing_lines_are_cut(spark):
    x = lines(spark, [(0, 0), (100, 100)], [(0, 100), (100, 0)])
    cut = prepare.segment_intersections(x)
    assert cut.count() == 4
    j = {(r.x, r.y): r.junct_cnt for r in prepare.junctions(cut, 0).collect()}
    assert j[50.0, 50.0] == 4
    assert prepare.segment_intersections(x, double_pass=True).count() == 4
    parallel = lines(spark, [(0, 0), (100, 0)], [(50, 0), (150, 0)])
    assert prepare.segment_intersections(parallel, extension=0.0).count() == 2


def test_densify_and_geometry(spark):
    d = prepare.densify(lines(spark, [(0, 0), (200, 0)], [(0, 0), (70, 0)]), 50.0)
    got = [(r.edge_id, r.n) for r in d.select("edge_id", F.round(G.length(F.col("geom")), 6).alias("n")).collect()]
    assert sorted(got) == [(0, 50.0)] * 4 + [(1, 70.0)]
    bent = lines(spark, [(0, 0), (30, 0), (30, 40)])
    r = bent.select(G.length(F.col("geom")).alias("n"), G.midpoint(F.col("geom")).alias("m"), G.part_by_vector(F.col("geom"), F.lit(-0.5)).alias("p"), G.to_wkt(F.col("geom")).alias("t"), G.centroid(F.col("geom")).alias("c")).first()
    assert r.n == 70 and tuple(r.m) == (30, 5) and [tuple(p) for p in r.p] == [(30, 5), (30, 40)]
    assert tuple(r.c) == pytest.approx(((30 * 15 + 40 * 30) / 70, 40 * 20 / 70))
    back = bent.select(G.from_wkt(G.to_wkt(F.col("geom"))).alias("g")).first().g
    assert [[tuple(p) for p in g] for g in back] == [[(0, 0), (30, 0), (30, 40)]]
    two = spark.createDataFrame([("MULTILINESTRING Z ((0 0 1, 1 0 1), (5 5 2, 6 6 2))",), ("POINT (1 2)",)], "w string").select(G.from_wkt(F.col("w")).alias("g")).collect()
    assert len(two[0].g) == 2 and two[1].g is None


def test_split_and_touch(spark):
    l = lines(spark, [(0, 0), (100, 0)])
    p = spark.createDataFrame([(0, 30.0, 0.0), (0, 60.0, 0.0005), (0, 50.0, 9.0), (0, 0.0, 0.0)], "edge_id long, x double, y double")
    assert sorted(r.n for r in prepare.split_lines(l, p).select(F.round(G.length(F.col("geom")), 2).alias("n")).collect()) == [30.0, 30.0, 40.0]
    t = prepare.touch_points(l, lines(spark, [(50, 0), (50, 80)], [(10, 5), (20, 5)])).collect()
    assert [(r.a_id, r.b_id, r.x, r.y) for r in t] == [(0, 0, 50.0, 0.0)]


def test_loops_and_parallel_edges(spark):
    nodes, edges = build.build_graph(lines(spark, [(0, 0), (10, 10), (0, 0)], [(0, 0), (9, 0)], [(0, 0), (9, 0)]))
    assert {r.node_id: r.junct_cnt for r in build.junction_counts(edges).collect()} == {0: 4, 1: 2}
    assert edges.count() == 3 and nodes.count() == 2


def test_changes_are_new_values(path):
    nodes, edges = path.nodes, path.edges
    n2, e2 = build.remove_edges(nodes, edges, edges.where("edge_id = 0").select("edge_id"))
    assert e2.count() == 2 and n2.count() == 3 and edges.count() == 3
    n3, e3 = build.remove_nodes(nodes, edges, nodes.where("x = 100").select("node_id"))
    assert e3.count() == 1 and n3.count() == 2
    more = edges.where("edge_id = 0").withColumn("edge_id", F.lit(9).cast("long")).withColumn("v", F.lit(77).cast("long"))
    n4, e4 = build.add_edges(nodes, edges, more)
    assert e4.count() == 4 and n4.count() == 5
    assert build.add_edges(nodes, edges, more, create_nodes=False)[1].count() == 3
    assert build.add_nodes(nodes, nodes.limit(1).withColumn("cost", F.lit(5.0))).agg(F.sum("cost")).first()[0] == 5.0
    s = snap.mapped(path.entries)
    assert build.remove_entries(s, s.where("entry_id = 0")).count() == 2 and build.add_entries(s, s.where("entry_id = 0")).count() == 3


def test_smallest_missing_and_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    assert build.smallest_missing(ids(0, 1, 3), "i").first().missing == 2
    assert build.smallest_missing(ids(5), "i").first().missing == 0
    assert build.smallest_missing(ids(), "i").first().missing == 0
    d = spark.range(100, 0, -7).repartition(5)
    assert [(r.k, r.id) for r in build.with_ids(d, "k", [F.col("id")]).orderBy("k").collect()] == list(enumerate(sorted(range(100, 0, -7))))


def test_ends_within_tolerance(spark):
    l = lines(spark, [(0, 0), (1, 0)], [(1.0008, 0), (2, 0)], [(1.0016, 0), (1, 5)], [(9, 9), (8, 8)])
    g = {(r.edge_id, r.end): r.group for r in build.snap_ends(l, 1e-3).collect()}
    assert g[0, 1] == g[1, 0] == g[2, 0] == 1 and len(set(g.values())) == 6


def dijkstra(arcs, start, limit):
    import heapq

    best, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for m, c in arcs.get(n, ()):
            if d + c <= limit and m not in best:
                heapq.heappush(heap, (d + c, m))
    return best


def test_random_network_against_dijkstra(spark):
    rng = random.Random(5)
    pts = [(rng.uniform(0, 500), rng.uniform(0, 500)) for _ in range(60)]
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(140)}
    nodes, edges = build.build_graph(lines(spark, *[[pts[a], pts[b]] for a, b in sorted(pairs)]))
    adjacent = {}
    for r in build.arcs(edges).collect():
        adjacent.setdefault(r.src, []).append((r.dst, r.cost))
    src = [0, 7, 21]
    got = {}
    for r in distance.node_distances(distance.weighted_arcs(edges, nodes), spark.createDataFrame([(s,) for s in src], "node_id long"), 700.0).collect():
        got.setdefault(r.o, {})[r.node] = r.dist
    for s in src:
        assert got[s] == pytest.approx(dijkstra(adjacent, s, 700.0))
    p = distance.node_paths(build.arcs(edges), spark.createDataFrame([(0, 21), (7, 3)], "src long, dst long"), 2000.0)
    again = {r.path_id: r.length for r in build.path_length(p.select(F.col("src").alias("path_id"), "edges"), edges).collect()}
    for r in p.collect():
        assert r.length == pytest.approx(dijkstra(adjacent, r.src, 2000.0)[r.dst])
        assert again[r.src] == pytest.approx(r.length if len(r.edges) > 1 else 0.0)


def test_batches(path):
    out = rows(path.reach_aggregate([("a", "b", 250.0, "weight"), ("b", "a", 120.0, None)], "category", "category", ReachBatchOptions(mode="NDW")), "entry_id")
    assert (out[0].b, out[0].b_D, out[0].b_W, out[0].a) == (2, 100.0, 5.0, 0)
    assert (out[1].a, out[2].a, out[1].b) == (1, 0, 0)
    scaled = path.scaled_weights("category", [("a", "weight", {"w2": 4.0}), ("b", "weight", {"w2": 0.5})])
    assert [r.w2 for r in scaled.entries.orderBy("entry_id").collect()] == [4.0, 1.0, 1.5]
    b = scaled.betweenness_aggregate([("t", "weight", "w2"), ("t", "w2", "weight", 150.0, 1.0, 0.0)], BetweennessBatchOptions(limit=250.0, detour=1.0))
    assert b.columns == ["edge_id", "t", "t_1"] and b.count() == 3


def test_traffic_is_conserved(path):
    t = path.traffic(options=BetweennessOptions(limit=250.0))
    sums = {r.o: r.s for r in t.groupBy("o").agg(F.sum("traffic").alias("s")).collect()}
    assert sums == pytest.approx({0: 1, 1: 2, 2: 3})


def test_hours(spark):
    w = timeprofile.hour_weights([("a", 12.0, 1.0, 0.0)])
    assert sum(w[h]["a"][0] for h in w) == pytest.approx(1.0, abs=1e-6)
    late = timeprofile.hour_weights([("a", 23.8, 2.0, 0.0)], wrap=True)
    assert sum(late[h]["a"][0] for h in late) == pytest.approx(1.0, abs=1e-3)
    d = timeprofile.spread_hours(spark.createDataFrame([(10.0,), (None,)], "a double"), [("a", 12.0, 1.0, 0.0)], spread=6)
    assert d.columns == ["a", "HrTrf_0", "HrTrf_6", "HrTrf_12", "HrTrf_18"] and d.first().HrTrf_12 == pytest.approx(3.829, abs=1e-3)


def test_ramps(spark):
    d = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    v = {r.v: r.width for r in style.value_ramp(d, "v", distribution="linear").collect()}
    assert v[0.0] == 1 and v[10.0] == 5 and v[5.0] == 3 and v[None] == 1
    c = {r.v: tuple(r.color) for r in style.color_ramp(d, "v").collect()}
    assert c[0.0] == c[None] == (68, 1, 84) and c[10.0] == (253, 231, 37) and c[5.0] == (49, 104, 142)
    r = d.select(style.hex_color(F.struct(F.lit(68).alias("r"), F.lit(1).alias("g"), F.lit(84).alias("b"))).alias("h"), style.red_blue(F.lit(True)).alias("f"), style.number_label(F.lit(1234.56)).alias("n"), style.rgb_only(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("c"), style.raised(G.point(F.lit(1.0), F.lit(2.0))).alias("p")).first()
    assert r.h == "#440154" and tuple(r.f) == (255, 0, 0) and r.n == "1,234.6" and tuple(r.c) == (1, 2, 3) and r.p == [1.0, 2.0, 2.0]


def test_layers_and_views(spark, path):
    layers = path.layers()
    assert layers["connectors"].count() == 3 and layers["centre"].first().x == 150
    path.register("t_")
    assert spark.sql("SELECT count(*) FROM t_edges JOIN t_arcs USING (edge_id)").first()[0] == 6


def test_segmented_session_with_parts(spark):
    """Two lines that cross, one of them as a part of several, are cut into a junction that routes can use."""
    parts = spark.createDataFrame([(7, [[(0.0, 0.0), (100.0, 100.0)]]), (8, [[(0.0, 100.0), (100.0, 0.0)], [(500.0, 0.0), (600.0, 0.0)]])], "fid long, parts array<array<struct<x:double,y:double>>>")
    e = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 100.0)], "fid long, x double, y double")
    plain = SpatialNetwork.from_lines(parts, e)
    assert plain.od(limit=500.0).count() == 0
    cut = SpatialNetwork.from_lines(parts, e, SessionOptions(segment=True))
    assert cut.entry_distance(0, 1, 500.0).first().pth == pytest.approx(math.sqrt(2) * 100, abs=0.01)
    assert len(cut.entry_paths(0, 1, BetweennessOptions(limit=500.0)).first().edges) == 2


def test_styled_layers(path):
    flows = path.betweenness(options=BetweennessOptions(limit=250.0))
    layer = path.attribute_layer(flows, "betweenness").collect()
    assert len(layer) == 3 and all(r.hex.startswith("#") and 1 <= r.width <= 5 and r.label_at is not None for r in layer)
    assert {r.label: tuple(r.color) for r in path.junction_layer().collect()} == {"1": (255, 0, 0), "2": (0, 0, 255)}


def test_metrics_need_no_weights(path):
    od = path.od(limit=250.0)
    none = path.entries.select(F.col("entry_id").alias("d"), F.lit(None).cast("double").alias("w"))
    assert {r.r_w for r in metrics.reach(od, none, "W", 250.0).collect()} == {2.0}


def test_node_routes(square):
    arcs = distance.weighted_arcs(square.edges)
    ids = {(r["x"], r["y"]): r["node_id"] for r in square.nodes.collect()}
    a, b, c = ids[0.0, 0.0], ids[100.0, 0.0], ids[100.0, 100.0]
    pairs = square.edges.sparkSession.createDataFrame([(a, c), (a, b), (b, b), (a, a), (a, c)], "src long, dst long")
    got = sorted((r["src"], r["dst"], r["length"], len(r["edges"])) for r in square.node_routes(pairs, 250.0, 3.0).collect())
    assert got == sorted([(a, c, 200.0, 2), (a, c, 200.0, 2), (a, b, 100.0, 1), (a, b, 300.0, 3), (b, b, 0.0, 0), (a, a, 0.0, 0)])
    assert {(r["src"], r["dst"]) for r in square.node_routes(pairs, 150.0, 3.0).collect()} == {(a, b), (b, b), (a, a)}
    assert square.node_routes(pairs, 250.0, 3.0, path_limit=1).count() == 4
    assert square.node_routes(pairs.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        paths.enumerate_node_paths(arcs, pairs, 250.0, 3.0, max_open=1).count()


def test_crossings_are_touch_points(spark):
    a = lines(spark, [(0, 0), (50, 0), (100, 0)], [(0, 500), (100, 500)])
    b = lines(spark, [(50, -10), (50, 10)], [(20, 0), (20, 90)], [(30, -10), (30, 10), (40, 10), (40, -10)], [(0, 0), (100, 0)])
    got = sorted((r["a_id"], r["b_id"], round(r["x"], 6), round(r["y"], 6)) for r in prepare.touch_points(a, b).collect())
    assert got == [(0, 0, 50, 0), (0, 1, 20, 0), (0, 2, 30, 0), (0, 2, 40, 0), (0, 3, 0, 0), (0, 3, 100, 0)]


def test_session_with_tolerance(spark):
    net = lines(spark, [(0, 0), (100, 0.00049)], [(100, 0.00051), (200, 0)], [(100, 50), (100, 100)])
    e = entries(spark, (50, 0, 1), (150, 0, 1))
    assert SpatialNetwork.from_lines(net, e).od().count() == 0
    n = SpatialNetwork.from_lines(net, e, SessionOptions(tolerance=1e-3))
    assert n.nodes.count() == 5
    assert n.od().count() == 2


def test_entries_of_removed_edges_stay(path):
    less = path.without_edges(path.edges.where("edge_id = 1").select("edge_id"))
    got = rows(less.entries, "entry_id")
    assert len(got) == 3
    assert [got[i]["edge_id"] for i in range(3)] == [0, None, 2]
    assert got[1]["category"] == "b" and got[1]["pos_o"] is None


def test_area_layers_and_dropping(path):
    area = path.area_layers([1], 100.0)
    assert set(area) == {"edges", "nodes", "origins"}
    assert {r["label"] for r in area["edges"].collect()} == {"100.0", "50.0"}
    assert [r["label"] for r in area["origins"].collect()] == ["1"]
    assert list(path.drop_layer(area, "nodes")) == ["edges", "origins"]
    assert list(path.drop_layer(area, -1)) == ["edges", "nodes"]
    with pytest.raises(KeyError):
        path.drop_layer(area, "roads")
