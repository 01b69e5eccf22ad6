"""Queries on the derived street grid, by name, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.functions import style
from streetweave.functions.timeprofile import hour_weights, spread_hours
from streetweave.operators import build, distance, metrics, prepare, service, snap
from streetweave.plans.network import SpatialNetwork
from streetweave.plans.options import BetweennessBatchOptions, BetweennessOptions, ReachBatchOptions, ReachOptions, StraightnessOptions
from streetweave.runtime import cut, scratch, shuffled
from streetweave.sources import derived, readers

_networks: dict[tuple, SpatialNetwork] = {}
_tables: dict[tuple, DataFrame] = {}



def network(spark: SparkSession, sf_dir: str, directed: bool = False, costs: bool = False) -> SpatialNetwork:
    """The grid with all entries snapped, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, directed, costs)
    if key not in _networks:
        nodes, edges = cut(derived.grid_nodes(spark, sf_dir, costs)), cut(derived.grid_edges(spark, sf_dir, directed))
        _networks[key] = SpatialNetwork(nodes, edges, cut(snap.snap_entries(derived.grid_entries(spark, sf_dir), edges, 100.0)))
    return _networks[key]


def forget() -> None:
    """Drop what is kept for the session, so that the next query works from the tables."""
    _networks.clear()
    _tables.clear()


def _ids(net: SpatialNetwork, kind: str, extra: str | None = None) -> DataFrame:
    e = net.entries.where(F.col("kind") == kind)
    return (e.where(extra) if extra else e).select("entry_id")


def _od(spark: SparkSession, sf_dir: str, limit: float, directed: bool = False, costs: bool = False) -> DataFrame:
    """Distances of origins to destinations, kept for the session: several metrics share one expansion."""
    key = (spark.sparkContext.applicationId, sf_dir, limit, directed, costs)
    if key not in _tables:
        net = network(spark, sf_dir, directed, costs)
        _tables[key] = cut(net.od(_ids(net, "origin"), _ids(net, "dest"), limit))
    return _tables[key]


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).entries.select(F.col("entry_id").alias("d"), F.col("weight").alias("w"))


def _r(c: str, digits: int = 4) -> F.Column:
    return F.round(c, digits).alias(c)


ROUTES = {"limit": 400.0, "detour": 1.15}


def _routes(spark: SparkSession, sf_dir: str, true_paths: bool = False, singular: bool = False, alpha: float = 0.5) -> tuple[SpatialNetwork, DataFrame, BetweennessOptions]:
    net = network(spark, sf_dir)
    o = BetweennessOptions(limit=ROUTES["limit"], detour=ROUTES["detour"], alpha=alpha, true_paths=true_paths, singular=singular, path_limit=None)
    key = (spark.sparkContext.applicationId, sf_dir, "routes", true_paths or singular)
    if key not in _tables:
        _tables[key] = cut(net.routes(_ids(net, "origin"), _ids(net, "dest"), o))
    return net, _tables[key], o


def _traffic(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    net, routes, o = _routes(spark, sf_dir, **kw)
    w = net.entries.select(F.col("entry_id").alias("d"), F.col("weight").alias("w"))
    return metrics.path_traffic(routes, w.select(F.col("d").alias("o"), F.col("w").alias("a")), w, o.alpha)


def _path_text(d: DataFrame) -> DataFrame:
    return d.select("o", "d", _r("length"), F.array_join("edges", "-").alias("edges"))


HOURS = [("amount", 8.0, 2.0, 1.5), ("amount2", 17.0, 3.0, -1.0)]
SPECS = [("S0", "BUILDING", 500.0, "weight"), ("S1", "MACHINERY", 400.0, "weight"), ("S2", "BUILDING", 300.0, "weight")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL of the grid: nodes, edges, pieces of edges, snapped entries.
def _base(directed: bool = False, costs: bool = False) -> str:
    back = "len * (1.0::DOUBLE + 0.1::DOUBLE * (sz % 3))" if directed else "len"
    cost = "CAST(sz % 5 AS DOUBLE)" if costs else "0.0::DOUBLE"
    return f"""WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
nodes AS (SELECT p_partkey AS id, CAST((p_partkey % w) * 100 + (p_partkey * 37) % 41 - 20 AS DOUBLE) AS x, CAST((p_partkey // w) * 100 + (p_partkey * 53) % 41 - 20 AS DOUBLE) AS y, CAST(p_size AS BIGINT) AS sz, n, w FROM part, n),
ncost AS (SELECT id, {cost} AS cost FROM nodes),
e0 AS (SELECT 2 * id AS edge_id, id AS u, id + 1 AS v, sz FROM nodes WHERE id % w + 1 < w AND id + 1 < n AND sz % 7 <> 0
  UNION ALL SELECT 2 * id + 1, id, id + w, sz FROM nodes WHERE id + w < n),
e1 AS (SELECT e0.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb, (a.x + b.x) / 2 + (e0.sz % 11 - 5) AS mx, (a.y + b.y) / 2 + (e0.sz % 13 - 6) AS my FROM e0 JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
e2 AS (SELECT *, sqrt((ax - mx) * (ax - mx) + (ay - my) * (ay - my)) AS l0, sqrt((mx - bx) * (mx - bx) + (my - yb) * (my - yb)) AS l1 FROM e1),
edges AS (SELECT *, {back} AS len_r FROM (SELECT *, l0 + l1 AS len FROM e2)),
arcs AS (SELECT u AS src, v AS dst, edge_id, len + c.cost AS cost FROM edges JOIN ncost c ON c.id = v UNION ALL SELECT v, u, edge_id, len_r + c.cost FROM edges JOIN ncost c ON c.id = u),
segs AS (SELECT edge_id, 0 AS seg, ax, ay, mx AS bx, my AS yb, l0 AS len, 0.0::DOUBLE AS at FROM edges UNION ALL SELECT edge_id, 1, mx, my, bx, yb, l1, l0 FROM edges),
entries AS (SELECT s_suppkey AS entry_id, CAST((s_suppkey * 7919) % (100 * w) AS DOUBLE) AS px, CAST((s_suppkey * 104729) % (100 * w) AS DOUBLE) AS py, greatest(s_acctbal, 0) AS weight, 'origin' AS kind, 'S' || (s_suppkey % 3) AS category FROM supplier, n
  UNION ALL SELECT c_custkey + 1000000, CAST((c_custkey * 7927) % (100 * w) AS DOUBLE), CAST((c_custkey * 104723) % (100 * w) AS DOUBLE), greatest(c_acctbal, 0), 'dest', c_mktsegment FROM customer, n),
near AS (SELECT *, sqrt((px - ix) * (px - ix) + (py - iy) * (py - iy)) AS dist FROM (SELECT *, ax + t * (bx - ax) AS ix, ay + t * (yb - ay) AS iy FROM
  (SELECT entry_id, px, py, s.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - ax) * (bx - ax) + (py - ay) * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)))) AS t FROM entries JOIN segs s
   ON greatest(ax, bx) >= px - 100 AND least(ax, bx) <= px + 100 AND greatest(ay, yb) >= py - 100 AND least(ay, yb) <= py + 100))),
best AS (SELECT * FROM near WHERE dist <= 100 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY dist, edge_id, seg) = 1),
snapped AS (SELECT e.entry_id, e.px, e.py, e.weight, e.kind, e.category, b.edge_id, b.dist AS snap_dist, b.at + b.t * b.len AS pos_o, g.len - (b.at + b.t * b.len) AS pos_d, b.ix, b.iy, g.u, g.v
  FROM entries e JOIN best b USING (entry_id) JOIN edges g ON g.edge_id = b.edge_id)"""


def _labels(limit: float, where: str = "kind = 'origin'", together: bool = False, name: str = "labels") -> str:
    o = "0" if together else "entry_id"
    return f""",
{name}_walk(o, node, dist) AS (SELECT {o}, u, pos_o FROM snapped WHERE {where} UNION SELECT {o}, v, pos_d FROM snapped WHERE {where}
  UNION SELECT w.o, a.dst, w.dist + a.cost FROM {name}_walk w JOIN arcs a ON a.src = w.node WHERE w.dist + a.cost <= {limit}),
{name} AS (SELECT o, node, min(dist) AS dist FROM {name}_walk GROUP BY o, node)"""


def _pairs(limit: float, name: str = "od", labels: str = "labels", o_where: str = "kind = 'origin'", d_where: str = "kind = 'dest'") -> str:
    return f""",
{name}_acc AS (SELECT entry_id AS d, u AS node, pos_o AS off FROM snapped WHERE {d_where} UNION ALL SELECT entry_id, v, pos_d FROM snapped WHERE {d_where}),
{name}_net AS (SELECT o, d, min(dist + off) AS pth FROM {labels} JOIN {name}_acc USING (node) GROUP BY o, d HAVING min(dist + off) <= {limit}),
{name}_all AS (SELECT x.o, x.d, pth, a.ix AS ox, a.iy AS oy, b.ix AS dx, b.iy AS dy, FALSE AS same_edge FROM {name}_net x JOIN snapped a ON a.entry_id = x.o JOIN snapped b ON b.entry_id = x.d WHERE a.edge_id <> b.edge_id
  UNION ALL SELECT a.entry_id, b.entry_id, CASE WHEN a.pos_o = b.pos_o THEN 0.1 ELSE abs(a.pos_o - b.pos_o) END, a.ix, a.iy, b.ix, b.iy, TRUE FROM (SELECT * FROM snapped WHERE {o_where}) a JOIN (SELECT * FROM snapped WHERE {d_where}) b ON a.edge_id = b.edge_id),
{name} AS (SELECT o, d, pth, CASE WHEN fly = 0 THEN 0.1 ELSE fly END AS fly, same_edge FROM (SELECT *, sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) AS fly FROM {name}_all) WHERE o <> d AND fly * 1.1::DOUBLE <= {limit})"""


def _od_sql(limit: float, directed: bool = False, costs: bool = False) -> str:
    return _base(directed, costs) + _labels(limit) + _pairs(limit) + ", odw AS (SELECT od.*, weight AS w, row_number() OVER (PARTITION BY o ORDER BY pth, d) - 1 AS k FROM od JOIN entries ON entry_id = d)\n"


def _routes_sql(monotone: bool) -> str:
    s, r = ROUTES["limit"], ROUTES["detour"]
    both = "weight > 0 AND kind = "
    rule = "AND l.dist <= p.lab" if monotone else ""
    return (
        _base()
        + _labels(s * r, both + "'origin'")
        + _pairs(s, "od", "labels", both + "'origin'", both + "'dest'")
        + f""",
todo AS (SELECT od.o, od.d, a.edge_id AS oe, b.edge_id AS de, pth * {r}::DOUBLE * {1 + 1e-9!r}::DOUBLE AS lim FROM od JOIN snapped a ON a.entry_id = o JOIN snapped b ON b.entry_id = d WHERE NOT same_edge),
start AS (SELECT t.*, x.node, x.off AS len, l.dist AS lab FROM todo t JOIN od_acc x ON x.d = t.d JOIN labels l ON l.o = t.o AND l.node = x.node WHERE x.off + l.dist <= t.lim),
open(o, d, oe, lim, node, len, lab, edges) AS (SELECT o, d, oe, lim, node, len, lab, [de] FROM start
  UNION ALL SELECT p.o, p.d, p.oe, p.lim, a.src, p.len + a.cost, l.dist, list_append(p.edges, a.edge_id) FROM open p JOIN arcs a ON a.dst = p.node JOIN labels l ON l.o = p.o AND l.node = a.src
  WHERE a.edge_id <> p.oe AND NOT list_contains(p.edges, a.edge_id) AND p.len + a.cost + l.dist <= p.lim {rule}),
oend AS (SELECT entry_id AS o, u AS node, pos_o AS off FROM snapped WHERE kind = 'origin' UNION ALL SELECT entry_id, v, pos_d FROM snapped WHERE kind = 'origin'),
routes AS (SELECT p.o, p.d, p.len + e.off AS length, list_reverse(list_append(p.edges, p.oe)) AS edges FROM open p JOIN oend e ON e.o = p.o AND e.node = p.node WHERE p.len + e.off <= p.lim AND NOT list_contains(p.edges, p.oe)
  UNION ALL SELECT od.o, od.d, pth, [a.edge_id] FROM od JOIN snapped a ON a.entry_id = od.o WHERE same_edge)
"""
    )


_TRAFFIC = """, share AS (SELECT r.*, b.weight * pow(CASE WHEN length = 0 THEN 0.1 ELSE length END, -1.5) AS s FROM routes r JOIN entries b ON b.entry_id = r.d),
traffic AS (SELECT s.*, CASE WHEN sum(s) OVER (PARTITION BY o) > 0 THEN a.weight * s / sum(s) OVER (PARTITION BY o) ELSE 0 END AS traffic FROM share s JOIN entries a ON a.entry_id = s.o)
"""
_BY_EDGE = "SELECT edge_id, round(sum(traffic), 3) AS betweenness FROM (SELECT unnest(edges) AS edge_id, traffic FROM traffic) GROUP BY edge_id"


@_query(_base() + " SELECT edge_id, u, v, round(len, 4) AS len FROM edges")
def net_edges(spark, sf_dir):
    return network(spark, sf_dir).edges.select("edge_id", "u", "v", _r("len"))


@_query(_base() + " SELECT id AS node_id, x, y, count(*) AS junct_cnt FROM nodes JOIN (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) USING (id) GROUP BY id, x, y")
def net_nodes_junctions(spark, sf_dir):
    return network(spark, sf_dir).junctions().select("node_id", "x", "y", "junct_cnt")


@_query(_base() + ", j AS (SELECT id, count(*) AS c FROM (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) GROUP BY id) SELECT round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END), 6) AS dead_end_ratio, avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END) > 0.3 AS needs_segmenting FROM j")
def net_dead_end_ratio(spark, sf_dir):
    return build.dead_end_ratio(network(spark, sf_dir).edges).select(_r("dead_end_ratio", 6), "needs_segmenting")


@_query(_base() + ", f AS (SELECT x, y, min(edge_id * 2 + e) AS seen FROM (SELECT edge_id, 0 AS e, ax AS x, ay AS y FROM edges UNION ALL SELECT edge_id, 1, bx, yb FROM edges) GROUP BY x, y) SELECT row_number() OVER (ORDER BY seen) - 1 AS node_id, x, y FROM f")
def net_build_nodes(spark, sf_dir):
    nodes, _ = build.build_graph(derived.grid_edges(spark, sf_dir).select("edge_id", "geom"))
    return nodes.select("node_id", "x", "y")


@_query(_base() + ", f AS (SELECT x, y, row_number() OVER (ORDER BY min(edge_id * 2 + e)) - 1 AS id FROM (SELECT edge_id, 0 AS e, ax AS x, ay AS y FROM edges UNION ALL SELECT edge_id, 1, bx, yb FROM edges) GROUP BY x, y) SELECT edge_id, a.id AS u, b.id AS v, round(len, 4) AS len FROM edges JOIN f a ON a.x = ax AND a.y = ay JOIN f b ON b.x = bx AND b.y = yb")
def net_build_edges(spark, sf_dir):
    _, edges = build.build_graph(derived.grid_edges(spark, sf_dir).select("edge_id", "geom"))
    return edges.select("edge_id", "u", "v", _r("len"))


@_query(_base() + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM snapped) AS n_entries")
def net_size_info(spark, sf_dir):
    return network(spark, sf_dir).size_info()


@_query(_base() + " SELECT entry_id, edge_id, round(snap_dist, 4) AS snap_dist, round(pos_o, 4) AS pos_o, round(pos_d, 4) AS pos_d, round(ix, 4) AS ix, round(iy, 4) AS iy FROM snapped")
def entry_snap(spark, sf_dir):
    return snap.mapped(network(spark, sf_dir).entries).select("entry_id", "edge_id", *[_r(c) for c in ("snap_dist", "pos_o", "pos_d", "ix", "iy")])


@_query(_base() + " SELECT kind, count(*) AS n FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM snapped) GROUP BY kind")
def entry_unmapped(spark, sf_dir):
    return network(spark, sf_dir).entries.where("edge_id IS NULL").groupBy("kind").agg(F.count("*").alias("n"))


@_query(_base() + _labels(500.0) + " SELECT o, node, round(dist, 4) AS dist FROM labels")
def labels_bounded(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.labels(net._ends(_ids(net, "origin")), 500.0).select("o", "node", _r("dist"))


_NODE_WALK = ", w(o, node, dist, path) AS (SELECT id, id, 0.0::DOUBLE, CAST([] AS BIGINT[]) FROM nodes UNION ALL SELECT w.o, a.dst, w.dist + a.cost, list_append(w.path, a.edge_id) FROM w JOIN arcs a ON a.src = w.node WHERE w.dist + a.cost <= 450 AND NOT list_contains(w.path, a.edge_id))"


@_query(_base() + _NODE_WALK + " SELECT o, node, round(min(dist), 4) AS dist FROM w GROUP BY o, node")
def node_shortest_distance(spark, sf_dir):
    net = network(spark, sf_dir)
    return distance.node_distances(net.arcs, net.nodes, 450.0).select("o", "node", _r("dist"))


@_query(_base() + _NODE_WALK + " SELECT o AS src, node AS dst, round(min(dist), 4) AS length, array_to_string(arg_min(path, dist), '-') AS edges FROM w WHERE node = o + 2 * (SELECT w FROM n) + 1 GROUP BY o, node")
def node_shortest_path(spark, sf_dir):
    net, (_, _, w) = network(spark, sf_dir), derived._grid(spark, sf_dir)
    pairs = net.nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 2 * w + 1).alias("dst"))
    return distance.node_paths(net.arcs, pairs, 450.0).select("src", "dst", _r("length"), F.array_join("edges", "-").alias("edges"))


@_query(_base() + _NODE_WALK + " SELECT o AS path_id, round(min(dist), 4) AS length FROM w WHERE node = o + 2 * (SELECT w FROM n) + 1 GROUP BY o, node")
def node_path_length(spark, sf_dir):
    """Lengths summed again from the paths' edges."""
    net, (_, _, w) = network(spark, sf_dir), derived._grid(spark, sf_dir)
    pairs = net.nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 2 * w + 1).alias("dst"))
    found = distance.node_paths(net.arcs, pairs, 450.0).select(F.col("src").alias("path_id"), "edges")
    return build.path_length(found, net.edges).select("path_id", _r("length"))


@_query(_base() + " SELECT a.id AS path_id, a.edge_id || '-' || b.edge_id AS edges FROM (SELECT u AS id, v, edge_id FROM edges) a JOIN edges b ON b.u = a.v AND b.edge_id % 2 = 1 WHERE a.edge_id % 2 = 1")
def node_path_edges(spark, sf_dir):
    net, (_, n, w) = network(spark, sf_dir), derived._grid(spark, sf_dir)
    p = net.nodes.where(F.col("node_id") + 2 * w < n).select(F.col("node_id").alias("path_id"), F.array(F.col("node_id"), F.col("node_id") + w, F.col("node_id") + 2 * w).alias("nodes"))
    return build.node_path_to_edges(p, net.edges).select("path_id", F.array_join("edges", "-").alias("edges"))


@_query(_od_sql(500.0) + "SELECT o, d, round(pth, 4) AS pth, round(fly, 4) AS fly FROM od")
def od_distance(spark, sf_dir):
    return _od(spark, sf_dir, 500.0).select("o", "d", _r("pth"), _r("fly"))


def _reach(spark, sf_dir, mode, exponent=0.35, **kw):
    out = metrics.reach(_od(spark, sf_dir, 500.0, **kw), _weights(spark, sf_dir), mode, 500.0, exponent, 0.6)
    return out.select("o", "r", *[_r(c) for c in out.columns if c in ("r_d", "r_w")])


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r FROM odw GROUP BY o")
def reach_n(spark, sf_dir):
    return _reach(spark, sf_dir, "N")


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(sum(w), 4) AS r_w FROM odw GROUP BY o")
def reach_w(spark, sf_dir):
    return _reach(spark, sf_dir, "W")


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(sum(abs(w * (1 - pth / 500) * pow(0.6, k))), 4) AS r_w FROM odw GROUP BY o")
def reach_wd_linear(spark, sf_dir):
    return _reach(spark, sf_dir, "WD", 0.0)


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(sum(w * exp(-0.35 * pth / 500) * (1 - pth / 500) * pow(0.6, k)), 4) AS r_w FROM odw GROUP BY o")
def reach_wd_neg(spark, sf_dir):
    return _reach(spark, sf_dir, "WD", -0.35)


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(sum(w * (pth / 500) * exp(0.35 * (pth / 500 - 1) * pow(0.6, k))), 4) AS r_w FROM odw GROUP BY o")
def reach_wd_pos(spark, sf_dir):
    return _reach(spark, sf_dir, "WD", 0.35)


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(min(pth), 4) AS r_d FROM odw GROUP BY o")
def reach_nd(spark, sf_dir):
    return _reach(spark, sf_dir, "ND")


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r, round(min(pth), 4) AS r_d, round(sum(w), 4) AS r_w FROM odw GROUP BY o")
def reach_ndw(spark, sf_dir):
    return _reach(spark, sf_dir, "NDW")


@_query(_od_sql(500.0) + ", f AS (SELECT o, count(*) AS c, sum(w) AS s FROM odw JOIN entries e ON e.entry_id = d JOIN entries oe ON oe.entry_id = o WHERE oe.category = 'S0' AND e.category = 'BUILDING' GROUP BY o) SELECT entry_id, coalesce(c, 0) AS reach, round(coalesce(s, 0), 4) AS reach_w FROM entries LEFT JOIN f ON f.o = entry_id WHERE kind = 'origin'")
def reach_filtered(spark, sf_dir):
    """Chosen origins and destinations, as columns of all entries."""
    net = network(spark, sf_dir)
    out = net.reach_column(_ids(net, "origin", "category = 'S0'"), _ids(net, "dest", "category = 'BUILDING'"), "W", ReachOptions(limit=500.0, result="reach"))
    return out.where("kind = 'origin'").select("entry_id", F.col("reach").cast("long").alias("reach"), F.round("reach_W", 4).alias("reach_w"))


def _straight(spark, sf_dir, exponent):
    return metrics.straightness(_od(spark, sf_dir, 500.0), _weights(spark, sf_dir), 500.0, exponent).select("o", _r("straightness"))


_STRAIGHT = "SELECT o, round(CASE WHEN sum({0}) > 0 THEN sum(fly / pth * {0}) / sum({0}) ELSE 0 END, 4) AS straightness FROM odw GROUP BY o"


@_query(_od_sql(500.0) + _STRAIGHT.format("w"))
def straightness_flat(spark, sf_dir):
    return _straight(spark, sf_dir, 0.0)


@_query(_od_sql(500.0) + _STRAIGHT.format("w * exp(-0.35 * (pth / 500)) * (1 - pth / 500)"))
def straightness_neg(spark, sf_dir):
    return _straight(spark, sf_dir, -0.35)


@_query(_od_sql(500.0) + _STRAIGHT.format("w * (pth / 500) * exp(0.35 * (pth / 500 - 1))"))
def straightness_pos(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.straightness(_ids(net, "origin"), _ids(net, "dest"), StraightnessOptions(limit=500.0)).select("o", _r("straightness"))


@_query(_od_sql(500.0, directed=True) + "SELECT o, count(*) AS r, round(min(pth), 4) AS r_d, round(sum(w), 4) AS r_w FROM odw GROUP BY o")
def directed_reach(spark, sf_dir):
    return _reach(spark, sf_dir, "NDW", directed=True)


@_query(_od_sql(500.0, costs=True) + "SELECT o, count(*) AS r, round(min(pth), 4) AS r_d, round(sum(w), 4) AS r_w FROM odw GROUP BY o")
def node_cost_reach(spark, sf_dir):
    return _reach(spark, sf_dir, "NDW", costs=True)


def _area_sql(together: bool, seeds: str | None = None) -> str:
    labels = _labels(350.0, together=together) if seeds is None else seeds
    own = f"SELECT DISTINCT {'0' if together else 'entry_id'} AS o, edge_id, TRUE AS own FROM snapped WHERE kind = 'origin'" if seeds is None else "SELECT 0 AS o, 0 AS edge_id, TRUE AS own WHERE FALSE"
    return (
        _base()
        + labels
        + f""", hit AS (SELECT l.o, e.edge_id, 1 AS side, (350.0::DOUBLE - dist) / len AS f FROM labels l JOIN edges e ON e.u = l.node WHERE dist <= 350 UNION ALL SELECT l.o, e.edge_id, -1, (350.0::DOUBLE - dist) / len_r FROM labels l JOIN edges e ON e.v = l.node WHERE dist <= 350),
cov AS (SELECT o, edge_id, max(CASE WHEN side = 1 THEN f END) AS fu, max(CASE WHEN side = -1 THEN f END) AS fv FROM hit GROUP BY o, edge_id),
own AS ({own}),
c2 AS (SELECT coalesce(cov.o, own.o) AS o, coalesce(cov.edge_id, own.edge_id) AS edge_id, fu, fv, coalesce(own, FALSE) OR coalesce(fu >= 1, FALSE) OR coalesce(fv >= 1, FALSE) OR coalesce(fu, 0) + coalesce(fv, 0) > 1 AS whole FROM cov FULL JOIN own ON cov.o = own.o AND cov.edge_id = own.edge_id),
area AS (SELECT o, edge_id, CASE WHEN fu IS NOT NULL OR fv IS NULL THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS vector FROM c2 WHERE whole UNION ALL SELECT o, edge_id, fu FROM c2 WHERE NOT whole AND fu > 0 UNION ALL SELECT o, edge_id, -fv FROM c2 WHERE NOT whole AND fv > 0)
"""
    )


@_query(_area_sql(False) + "SELECT o, edge_id, round(vector, 4) AS vector FROM area")
def service_area_single(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.service_area(_ids(net, "origin"), 350.0).select("o", "edge_id", _r("vector"))


@_query(_area_sql(True) + "SELECT edge_id, round(vector, 4) AS vector FROM area")
def service_area_joined(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.service_area(_ids(net, "origin"), 350.0, joined=True).select("edge_id", _r("vector"))


@_query(_area_sql(True) + "SELECT edge_id, round(sum(abs(vector) * len), 2) AS covered FROM area JOIN edges USING (edge_id) GROUP BY edge_id")
def service_area_length(spark, sf_dir):
    """Lengths of the cut geometries."""
    net = network(spark, sf_dir)
    a = net.service_area(_ids(net, "origin"), 350.0, joined=True, geometry=True)
    return a.groupBy("edge_id").agg(F.round(F.sum(G.length(F.col("geom"))), 2).alias("covered"))


@_query(_base() + _labels(350.0) + " SELECT o, node AS node_id, round(dist, 4) AS dist, x, y FROM labels JOIN nodes ON id = node WHERE dist <= 350")
def service_area_nodes(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.service_nodes(_ids(net, "origin"), 350.0).select("o", "node_id", _r("dist"), "x", "y")


_FROM_NODES = ", lw(o, node, dist) AS (SELECT id, id, 0.0::DOUBLE FROM nodes UNION SELECT lw.o, a.dst, lw.dist + a.cost FROM lw JOIN arcs a ON a.src = lw.node WHERE lw.dist + a.cost <= 350), labels AS (SELECT o, node, min(dist) AS dist FROM lw GROUP BY o, node)"


@_query(_area_sql(False, _FROM_NODES) + "SELECT o, edge_id, round(vector, 4) AS vector FROM area")
def service_area_from_node(spark, sf_dir):
    net = network(spark, sf_dir)
    labels = distance.node_distances(net.arcs, net.nodes, 350.0)
    return service.service_area(labels, net.edges, 350.0).select("o", "edge_id", _r("vector"))


@_query(_routes_sql(True) + "SELECT o, d, round(length, 4) AS length, array_to_string(edges, '-') AS edges FROM routes")
def paths_monotone(spark, sf_dir):
    return _path_text(_routes(spark, sf_dir)[1])


@_query(_routes_sql(False) + "SELECT o, d, round(length, 4) AS length, array_to_string(edges, '-') AS edges FROM routes")
def paths_true(spark, sf_dir):
    return _path_text(_routes(spark, sf_dir, true_paths=True)[1])


@_query(_routes_sql(True) + _TRAFFIC + _BY_EDGE)
def betweenness_plural(spark, sf_dir):
    return metrics.edge_traffic(_traffic(spark, sf_dir)).select("edge_id", _r("betweenness", 3))


@_query(_routes_sql(True) + _TRAFFIC + "SELECT d, round(sum(traffic), 3) AS patronage FROM traffic GROUP BY d")
def betweenness_destinations(spark, sf_dir):
    return metrics.destination_traffic(_traffic(spark, sf_dir)).select("d", _r("patronage", 3))


@_query(_routes_sql(False) + _TRAFFIC + _BY_EDGE)
def betweenness_true_paths(spark, sf_dir):
    return metrics.edge_traffic(_traffic(spark, sf_dir, true_paths=True)).select("edge_id", _r("betweenness", 3))


@_query(_routes_sql(False) + _TRAFFIC + _BY_EDGE)
def betweenness_singular(spark, sf_dir):
    return metrics.edge_traffic(_traffic(spark, sf_dir, singular=True)).select("edge_id", _r("betweenness", 3))


def _spec_sql() -> str:
    parts = [f"SELECT {i} AS spec, '{a}' AS ov, '{b}' AS dv, {d} AS far" for i, (a, b, d, _) in enumerate(SPECS)]
    return _od_sql(500.0) + f", specs AS ({' UNION ALL '.join(parts)}), hits AS (SELECT s.*, odw.o, odw.pth, odw.w FROM odw JOIN entries a ON a.entry_id = o JOIN entries b ON b.entry_id = d JOIN specs s ON s.ov = a.category AND s.dv = b.category WHERE (pth <= far OR same_edge) AND fly * 1.1::DOUBLE <= far), sums AS (SELECT spec, dv, o, count(*) AS c, min(pth) AS m, sum(w) AS w FROM hits GROUP BY spec, dv, o)"


_SPEC_COLUMNS = ", ".join(f"coalesce(max(CASE WHEN dv = '{n}' THEN {e} END), 0) AS {n.lower()}{s}" for n in ("BUILDING", "MACHINERY") for e, s in (("CAST(c AS DOUBLE)", ""), ("round(m, 4)", "_d"), ("round(sums.w, 4)", "_w")))


@_query(_spec_sql() + f" SELECT entry_id, {_SPEC_COLUMNS} FROM entries LEFT JOIN sums ON sums.o = entry_id WHERE kind = 'origin' GROUP BY entry_id")
def reach_aggregate(spark, sf_dir):
    net = network(spark, sf_dir)
    out = net.reach_aggregate(SPECS, "category", "category", ReachBatchOptions(mode="NDW"))
    return out.where("kind = 'origin'").select("entry_id", *[F.round(f"{n}{s}", 4).alias(f"{n}{s}".lower()) for n in ("BUILDING", "MACHINERY") for s in ("", "_D", "_W")])


def _batch_sql() -> str:
    one = _routes_sql(True).replace("WITH RECURSIVE", "WITH RECURSIVE", 1)
    return one + """, wts AS (SELECT entry_id, CASE WHEN category IN ('S0', 'BUILDING') THEN weight * 2.0 ELSE 0 END AS wa FROM entries),
share1 AS (SELECT r.*, b.weight * pow(CASE WHEN length = 0 THEN 0.1 ELSE length END, -1.35) AS s FROM routes r JOIN entries b ON b.entry_id = r.d),
t1 AS (SELECT s.*, a.weight * s / sum(s) OVER (PARTITION BY o) AS traffic FROM share1 s JOIN entries a ON a.entry_id = s.o),
share2 AS (SELECT r.*, b.wa * pow(CASE WHEN length = 0 THEN 0.1 ELSE length END, -1.35) AS s, a.wa AS own FROM routes r JOIN wts b ON b.entry_id = r.d JOIN wts a ON a.entry_id = r.o WHERE b.wa > 0 AND a.wa > 0),
t2 AS (SELECT *, own * s / sum(s) OVER (PARTITION BY o) AS traffic FROM share2),
x1 AS (SELECT edge_id, sum(traffic) AS v FROM (SELECT unnest(edges) AS edge_id, traffic FROM t1) GROUP BY edge_id), x2 AS (SELECT edge_id, sum(traffic) AS v FROM (SELECT unnest(edges) AS edge_id, traffic FROM t2) GROUP BY edge_id)
SELECT e.edge_id, round(coalesce(x1.v, 0), 3) AS all_trips, round(coalesce(x2.v, 0), 3) AS some_trips FROM edges e LEFT JOIN x1 ON x1.edge_id = e.edge_id LEFT JOIN x2 ON x2.edge_id = e.edge_id"""


@_query(_batch_sql())
def betweenness_aggregate(spark, sf_dir):
    net = network(spark, sf_dir)
    rules = [("S0", "weight", {"wa": 2.0}), ("BUILDING", "weight", {"wa": 2.0})]
    split = SpatialNetwork(net.nodes, net.edges, net.entries.withColumn("wo", F.when(F.col("kind") == "origin", F.col("weight")).otherwise(F.lit(0.0))).withColumn("wd", F.when(F.col("kind") == "dest", F.col("weight")).otherwise(F.lit(0.0))))
    split = split.scaled_weights("category", rules)
    e = split.entries.withColumn("wao", F.when(F.col("kind") == "origin", F.col("wa")).otherwise(F.lit(0.0))).withColumn("wad", F.when(F.col("kind") == "dest", F.col("wa")).otherwise(F.lit(0.0)))
    out = SpatialNetwork(net.nodes, net.edges, cut(e)).betweenness_aggregate([("all_trips", "wo", "wd", ROUTES["limit"], ROUTES["detour"]), ("some_trips", "wao", "wad", ROUTES["limit"], ROUTES["detour"])], BetweennessBatchOptions(path_limit=None))
    return out.select("edge_id", _r("all_trips", 3), _r("some_trips", 3))


def _hours_sql(wrap: bool) -> str:
    columns = []
    for hour, weights in hour_weights(HOURS, wrap=wrap).items():
        terms = " + ".join(f"coalesce({c}, 0) * {w!r}::DOUBLE" for c, ws in weights.items() for w in ws)
        columns.append(f"round({terms}, 4) AS HrTrf_{hour}")
    return f"WITH a AS (SELECT o_orderkey AS id, o_totalprice AS amount, CAST(o_orderkey % 100 AS DOUBLE) AS amount2 FROM orders) SELECT id, {', '.join(columns)} FROM a"


def _hours(spark, sf_dir, wrap):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 100).cast("double").alias("amount2"))
    return spread_hours(a, HOURS, wrap=wrap).select("id", *[_r(f"HrTrf_{h}") for h in range(24)])


@_query(_hours_sql(False))
def hourly_spread(spark, sf_dir):
    return _hours(spark, sf_dir, False)


@_query(_hours_sql(True))
def hourly_spread_wrap(spark, sf_dir):
    return _hours(spark, sf_dir, True)


@_query(_base() + ", p AS (SELECT edge_id, len, CASE WHEN len > 45 THEN CAST(round(len / 30) AS BIGINT) ELSE 1 END AS k FROM edges) SELECT edge_id, unnest(range(k)) AS piece, round(len / k, 3) AS len FROM p")
def densify(spark, sf_dir):
    d = prepare.densify(network(spark, sf_dir).edges.select("edge_id", "geom"), 30.0)
    return d.select("edge_id", F.col("piece").cast("long").alias("piece"), F.round(G.length(F.col("geom")), 3).alias("len"))


@_query(_base() + " SELECT edge_id, round(ax + (ax - mx) * (5.0::DOUBLE / l0), 4) AS x0, round(ay + (ay - my) * (5.0::DOUBLE / l0), 4) AS y0, round(bx + (bx - mx) * (5.0::DOUBLE / l1), 4) AS x1, round(yb + (yb - my) * (5.0::DOUBLE / l1), 4) AS y1, round(len + 10, 4) AS len FROM edges")
def extend_lines(spark, sf_dir):
    d = prepare.extend_lines(network(spark, sf_dir).edges.select("edge_id", "geom"), 5.0)
    first, last = F.get("geom", F.lit(0)), F.element_at("geom", -1)
    return d.select("edge_id", F.round(first["x"], 4).alias("x0"), F.round(first["y"], 4).alias("y0"), F.round(last["x"], 4).alias("x1"), F.round(last["y"], 4).alias("y1"), F.round(G.length(F.col("geom")), 4).alias("len"))


@_query(_base() + " SELECT edge_id, 3 AS n_points, round(len, 4) AS len FROM edges")
def flatten_lines(spark, sf_dir):
    e = network(spark, sf_dir).edges.withColumn("geom", F.transform("geom", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(7.0).alias("z"))))
    d = prepare.flatten_lines(e.select("edge_id", "geom"))
    return d.select("edge_id", F.size("geom").alias("n_points"), F.round(G.length(F.col("geom")), 4).alias("len"))


@_query(_base() + " SELECT u AS street, row_number() OVER (PARTITION BY u ORDER BY edge_id) - 1 AS part_no, round(len, 4) AS len FROM edges")
def explode_multilines(spark, sf_dir):
    e = network(spark, sf_dir).edges
    multi = e.groupBy(F.col("u").alias("street")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "geom"))), lambda x: x["geom"]).alias("parts"))
    return prepare.explode_multilines(multi).select("street", F.col("part_no").cast("long").alias("part_no"), F.round(G.length(F.col("geom")), 4).alias("len"))


@_query(_base() + ", b AS (SELECT edge_id, least(ax, mx, bx) - 1 AS x0, least(ay, my, yb) - 1 AS y0, greatest(ax, mx, bx) + 1 AS x1, greatest(ay, my, yb) + 1 AS y1 FROM edges) SELECT p.edge_id AS a, q.edge_id AS b FROM b p JOIN b q ON p.edge_id < q.edge_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1")
def bbox_overlap_pairs(spark, sf_dir):
    return prepare.overlapping_boxes(network(spark, sf_dir).edges.select("edge_id", "geom"), 1.0)


_DIAGONALS = (
    _base()
    + """, dg AS (SELECT 2 * id AS edge_id, id AS u, id + w + 1 AS v FROM nodes WHERE id % w + 1 < w AND id + w + 1 < n UNION ALL SELECT 2 * id + 1, id + 1, id + w FROM nodes WHERE id % w + 1 < w AND id + w + 1 < n),
dl AS (SELECT edge_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS len FROM dg JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
cr AS (SELECT p.edge_id, p.len, ((q.ax - p.ax) * (q.yb - q.ay) - (q.ay - p.ay) * (q.bx - q.ax)) / det AS t, ((q.ax - p.ax) * (p.yb - p.ay) - (q.ay - p.ay) * (p.bx - p.ax)) / det AS s FROM (SELECT p, q, (p.bx - p.ax) * (q.yb - q.ay) - (p.yb - p.ay) * (q.bx - q.ax) AS det FROM dl p JOIN dl q ON p.edge_id <> q.edge_id) WHERE abs(det) > 1e-12),
ct AS (SELECT DISTINCT edge_id, round(t * len, 3) AS pos FROM cr WHERE t >= -1e-6 AND t <= 1 + 1e-6 AND s >= -1e-6 AND s <= 1 + 1e-6 AND t * len > 1e-3 AND t * len < len - 1e-3),
st AS (SELECT edge_id, 0.0::DOUBLE AS pos FROM dl UNION ALL SELECT * FROM ct UNION ALL SELECT edge_id, len FROM dl),
pc AS (SELECT edge_id, row_number() OVER w - 1 AS piece, lead(pos) OVER w - pos AS len, count(*) OVER (PARTITION BY edge_id) AS c FROM st WINDOW w AS (PARTITION BY edge_id ORDER BY pos))
SELECT edge_id, piece, round(len, 3) AS len FROM pc WHERE len IS NOT NULL AND (c = 2 OR (len > 0.05 AND NOT ((piece = 0 OR piece = c - 2) AND len < 0.1)))"""
)


@_query(_DIAGONALS)
def segment_intersections(spark, sf_dir):
    d = prepare.segment_intersections(derived.diagonals(spark, sf_dir), extension=0.0)
    return d.select("edge_id", F.col("piece").cast("long").alias("piece"), F.round(G.length(F.col("geom")), 3).alias("len"))


@_query(_base() + " SELECT x, y, count(*) AS junct_cnt FROM (SELECT ax AS x, ay AS y FROM edges UNION ALL SELECT bx, yb FROM edges) GROUP BY x, y")
def junction_compile(spark, sf_dir):
    return prepare.junctions(network(spark, sf_dir).edges)


@_query(_base() + ", j AS (SELECT x, y FROM (SELECT ax AS x, ay AS y FROM edges UNION ALL SELECT bx, yb FROM edges) GROUP BY x, y HAVING count(*) = 1) SELECT edge_id, EXISTS (SELECT 1 FROM j WHERE (x = ax AND y = ay) OR (x = bx AND y = yb)) AS dead_end FROM edges")
def dead_end_lines(spark, sf_dir):
    return prepare.mark_dead_ends(network(spark, sf_dir).edges.select("edge_id", "geom")).select("edge_id", "dead_end")


@_query(_base().replace("arcs AS (", "all_arcs AS (", 1).replace("segs AS (", "long_edges AS (SELECT edge_id FROM edges WHERE len > 115),\narcs AS (SELECT * FROM all_arcs WHERE edge_id NOT IN (SELECT edge_id FROM long_edges)),\nsegs AS (", 1).replace("snapped AS (", "kept AS (SELECT * FROM best WHERE edge_id NOT IN (SELECT edge_id FROM long_edges)),\nsnapped AS (", 1).replace("JOIN best b USING", "JOIN kept b USING", 1) + _labels(500.0) + _pairs(500.0) + " SELECT o, count(*) AS r, round(min(pth), 4) AS r_d FROM od GROUP BY o")
def edge_removed_graph(spark, sf_dir):
    net = network(spark, sf_dir)
    less = net.without_edges(net.edges.where("len > 115").select("edge_id"))
    return metrics.reach(less.od(_ids(less, "origin"), _ids(less, "dest"), 500.0), _weights(spark, sf_dir), "ND", 500.0).select("o", "r", _r("r_d"))


@_query(_base() + ", e5 AS (SELECT * FROM edges WHERE ax >= 500 AND bx >= 500) SELECT (SELECT count(*) FROM e5) AS n_edges, (SELECT count(*) FROM (SELECT u FROM e5 UNION SELECT v FROM e5)) AS n_nodes")
def node_removed_graph(spark, sf_dir):
    net = network(spark, sf_dir)
    nodes, edges = build.remove_nodes(net.nodes, net.edges, net.nodes.where("x < 500").select("node_id"))
    return build.size_info(nodes, edges, edges.limit(0)).select("n_edges", "n_nodes")


@_query(_base() + " SELECT min(i) AS missing FROM range(1000000) r(i) WHERE i NOT IN (SELECT edge_id FROM edges)")
def smallest_missing_id(spark, sf_dir):
    return build.smallest_missing(network(spark, sf_dir).edges, "edge_id")


_BREAKS = "b AS (SELECT quantile_cont(len, [{}]) AS q FROM edges), s AS (SELECT edge_id, len, q, least({p} - 1, greatest(0, len(list_filter(q, lambda x: x <= len)) - 1)) AS k FROM edges, b), z AS (SELECT edge_id, least(1.0::DOUBLE, (k + CASE WHEN q[k + 2] > q[k + 1] THEN (len - q[k + 1]) / (q[k + 2] - q[k + 1]) ELSE 0 END) / {p}) AS s FROM s)"


def _breaks(parts: int) -> str:
    return ", " + _BREAKS.replace("{}", ", ".join(repr(k / parts) for k in range(parts + 1))).replace("{p}", str(parts)).replace("lambda x: x <= len)", "lambda x: x <= edges.len)")


def _channel(c: int) -> str:
    table = ", ".join(str(s[c]) for s in style.PALETTES["viridis"])
    return f"CAST(floor(([{table}])[k + 1] + (([{table}])[k + 2] - ([{table}])[k + 1]) * (s * 6 - k)) AS INTEGER)"


@_query(_base() + _breaks(10) + ", y AS (SELECT edge_id, s, CAST(least(floor(s * 6), 5) AS INTEGER) AS k FROM z) SELECT edge_id, " + ", ".join(f"{_channel(i)} AS {c}" for i, c in enumerate("rgb")) + " FROM y")
def colour_ramp(spark, sf_dir):
    e = network(spark, sf_dir).edges.select("edge_id", F.col("len").alias("value"))
    return style.color_ramp(e, "value").select("edge_id", "color.r", "color.g", "color.b")


@_query(_base() + _breaks(4) + " SELECT edge_id, round(1.0 + s * 4.0, 4) AS width FROM z")
def value_ramp(spark, sf_dir):
    e = network(spark, sf_dir).edges.select("edge_id", F.col("len").alias("value"))
    return style.value_ramp(e, "value", distribution="quantile").select("edge_id", _r("width"))


@_query(_base() + " SELECT id AS node_id, '#' || lower(lpad(to_hex(id % 256), 2, '0') || lpad(to_hex(id * 7 % 256), 2, '0') || lpad(to_hex(id * 13 % 256), 2, '0')) AS color FROM nodes")
def hex_colour(spark, sf_dir):
    i = F.col("node_id")
    c = F.struct((i % 256).alias("r"), (i * 7 % 256).alias("g"), (i * 13 % 256).alias("b"))
    return network(spark, sf_dir).nodes.select("node_id", style.hex_color(c).alias("color"))


@_query(_base() + " SELECT edge_id, round((l0 * (ax + mx) / 2 + l1 * (mx + bx) / 2) / len, 4) AS cx, round((l0 * (ay + my) / 2 + l1 * (my + yb) / 2) / len, 4) AS cy, round(CASE WHEN len / 2 <= l0 THEN ax + (mx - ax) * (len / 2 / l0) ELSE mx + (bx - mx) * ((len / 2 - l0) / l1) END, 4) AS mx, round(len, 1) AS label FROM edges")
def line_points(spark, sf_dir):
    g = F.col("geom")
    return network(spark, sf_dir).edges.select("edge_id", F.round(G.centroid(g)["x"], 4).alias("cx"), F.round(G.centroid(g)["y"], 4).alias("cy"), F.round(G.midpoint(g)["x"], 4).alias("mx"), F.round("len", 1).alias("label"))


@_query(_base() + " SELECT entry_id, px AS x0, py AS y0, round(ix, 4) AS x1, round(iy, 4) AS y1 FROM snapped")
def map_connectors(spark, sf_dir):
    c = network(spark, sf_dir).layers()["connectors"]
    a, b = F.get("geom", F.lit(0)), F.get("geom", F.lit(1))
    return c.select("entry_id", a["x"].alias("x0"), a["y"].alias("y0"), F.round(b["x"], 4).alias("x1"), F.round(b["y"], 4).alias("y1"))


@_query(
    _base()
    + """, pr AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON b.id = a.id + a.w + 1 WHERE a.id % a.w + 1 < a.w),
wk(src, dst, node, len, edges) AS (SELECT src, dst, src, 0.0::DOUBLE, CAST([] AS BIGINT[]) FROM pr
  UNION ALL SELECT p.src, p.dst, a.dst, p.len + a.cost, list_append(p.edges, a.edge_id) FROM wk p JOIN arcs a ON a.src = p.node WHERE p.node <> p.dst AND p.len + a.cost <= 450 AND NOT list_contains(p.edges, a.edge_id)),
mn AS (SELECT src, dst, min(len) AS m FROM wk WHERE node = dst GROUP BY src, dst HAVING min(len) <= 300)
SELECT src, dst, round(len, 4) AS length, array_to_string(edges, '-') AS edges FROM wk JOIN mn USING (src, dst) WHERE node = dst AND len <= m * 1.5::DOUBLE * 1.000000001::DOUBLE"""
)
def node_routes(spark, sf_dir):
    """All routes across a cell of the grid, from corner to corner."""
    net, (_, n, w) = network(spark, sf_dir), derived._grid(spark, sf_dir)
    i = F.col("node_id")
    pairs = net.nodes.where((i % w + 1 < w) & (i + w + 1 < n)).select(i.alias("src"), (i + w + 1).alias("dst"))
    return net.node_routes(pairs, 300.0, 1.5).select("src", "dst", _r("length"), F.array_join("edges", "-").alias("edges"))


@_query(_routes_sql(False) + ", one AS (SELECT o, d FROM od WHERE NOT same_edge ORDER BY o, d LIMIT 1) SELECT o, d, round(length, 4) AS length, array_to_string(edges, '-') AS edges FROM routes JOIN one USING (o, d)")
def entry_pair_routes(spark, sf_dir):
    """The routes of one pair of entries, the first with weights that isn't on one edge."""
    net, _, o = _routes(spark, sf_dir, true_paths=True)
    weighed = net.entries.where("weight > 0")
    src, dst = (net._ends(weighed.where(F.col("kind") == k).select("entry_id")) for k in ("origin", "dest"))
    od = distance.od_distances(net.labels(src, o.limit), src, dst, o.limit)
    pair = od.where("NOT same_edge").agg(F.min(F.struct("o", "d")).alias("p")).first()["p"]
    return _path_text(net.entry_paths(pair["o"], pair["d"], o))


@_query(_base() + """, dg AS (SELECT 2 * id AS edge_id, id AS u, id + w + 1 AS v FROM nodes WHERE id % w + 1 < w AND id + w + 1 < n UNION ALL SELECT 2 * id + 1, id + 1, id + w FROM nodes WHERE id % w + 1 < w AND id + w + 1 < n),
dl AS (SELECT edge_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM dg JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
en AS (SELECT edge_id, ax AS x, ay AS y FROM dl UNION SELECT edge_id, bx, yb FROM dl),
ends AS (SELECT DISTINCT s.edge_id AS a_id, e.edge_id AS b_id, e.x, e.y FROM segs s JOIN en e ON (s.ax = e.x AND s.ay = e.y) OR (s.bx = e.x AND s.yb = e.y)),
cr AS (SELECT s.edge_id AS a_id, d.edge_id AS b_id, s.ax AS sx, s.ay AS sy, s.bx AS tx, s.yb AS ty, ((d.ax - s.ax) * (d.yb - d.ay) - (d.ay - s.ay) * (d.bx - d.ax)) / det AS t, ((d.ax - s.ax) * (s.yb - s.ay) - (d.ay - s.ay) * (s.bx - s.ax)) / det AS q
  FROM (SELECT s, d, (s.bx - s.ax) * (d.yb - d.ay) - (s.yb - s.ay) * (d.bx - d.ax) AS det FROM segs s JOIN dl d ON greatest(s.ax, s.bx) >= least(d.ax, d.bx) AND least(s.ax, s.bx) <= greatest(d.ax, d.bx) AND greatest(s.ay, s.yb) >= least(d.ay, d.yb) AND least(s.ay, s.yb) <= greatest(d.ay, d.yb)) WHERE abs(det) > 1e-12),
pt AS (SELECT DISTINCT a_id, b_id, round(sx + t * (tx - sx), 2) AS x, round(sy + t * (ty - sy), 2) AS y FROM cr WHERE t BETWEEN -1e-6 AND 1 + 1e-6 AND q BETWEEN -1e-6 AND 1 + 1e-6)
SELECT a_id, b_id, x, y FROM ends UNION ALL SELECT * FROM pt WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.a_id = pt.a_id AND e.b_id = pt.b_id AND abs(e.x - pt.x) < 0.05 AND abs(e.y - pt.y) < 0.05)""")
def touch_points(spark, sf_dir):
    """Where the diagonals end on streets or cross them."""
    out = prepare.touch_points(network(spark, sf_dir).edges.select("edge_id", "geom"), derived.diagonals(spark, sf_dir))
    return out.select("a_id", "b_id", _r("x", 2), _r("y", 2))


@_query(_base() + """, c AS (SELECT edge_id, l0 / 2 AS pos FROM edges WHERE edge_id % 3 = 0 UNION ALL SELECT edge_id, l0 + l1 / 2 FROM edges WHERE edge_id % 2 = 0),
s AS (SELECT edge_id, 0.0::DOUBLE AS pos FROM edges UNION ALL SELECT * FROM c UNION ALL SELECT edge_id, len FROM edges)
SELECT edge_id, piece, round(len, 3) AS len FROM (SELECT edge_id, row_number() OVER w - 1 AS piece, lead(pos) OVER w - pos AS len FROM s WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) WHERE len IS NOT NULL""")
def split_at_points(spark, sf_dir):
    """Edges cut in the middle of their first or second half, or of both."""
    e = network(spark, sf_dir).edges.select("edge_id", "geom")
    middle = lambda k: G.point((F.get("geom", F.lit(k))["x"] + F.get("geom", F.lit(k + 1))["x"]) / 2, (F.get("geom", F.lit(k))["y"] + F.get("geom", F.lit(k + 1))["y"]) / 2)
    at = e.where("edge_id % 3 = 0").select("edge_id", middle(0).alias("p")).unionByName(e.where("edge_id % 2 = 0").select("edge_id", middle(1).alias("p")))
    out = prepare.split_lines(e, at.select("edge_id", "p.x", "p.y"))
    return out.select("edge_id", F.col("piece").cast("long").alias("piece"), F.round(G.length(F.col("geom")), 3).alias("len"))


@_query(_base() + ", f AS (SELECT id, row_number() OVER (ORDER BY min(seen)) - 1 AS k FROM (SELECT u AS id, edge_id * 2 AS seen FROM edges UNION ALL SELECT v, edge_id * 2 + 1 FROM edges) GROUP BY id) SELECT edge_id, a.k AS u, b.k AS v FROM edges JOIN f a ON a.id = u JOIN f b ON b.id = v")
def build_with_tolerance(spark, sf_dir):
    """Ends moved by up to 0.0008, which rounding would part, are one node again within a tolerance of 0.001."""
    e = network(spark, sf_dir).edges.select("edge_id", "geom")
    nudge = lambda p: F.struct((p["x"] + (F.col("edge_id") % 3) * 0.0004).alias("x"), p["y"].alias("y"))
    _, edges = build.build_graph(e.withColumn("geom", F.transform("geom", nudge)), tolerance=1e-3)
    return edges.select("edge_id", "u", "v")


@_query(_base() + " SELECT row_number() OVER (ORDER BY x, y) - 1 AS entry_id, x, y FROM nodes")
def ids_when_absent(spark, sf_dir):
    return build.with_ids(network(spark, sf_dir).nodes.select("x", "y"), "entry_id")


@_query(_base() + ", j AS (SELECT id, max(id) OVER () + 1 + id AS n2 FROM nodes) SELECT node_id, x, y FROM (SELECT id AS node_id, CASE WHEN id % 5 = 0 THEN x + 1 ELSE x END AS x, y FROM nodes UNION ALL SELECT j.n2, x + 10, y + 10 FROM nodes JOIN j USING (id) WHERE id % 10 = 0)")
def add_nodes(spark, sf_dir):
    """A fifth of the nodes replaced by moved ones; ends of new edges added as nodes."""
    net = network(spark, sf_dir)
    nodes = build.add_nodes(net.nodes, net.nodes.where("node_id % 5 = 0").withColumn("x", F.col("x") + 1))
    return build.add_edges(nodes, net.edges, _spurs(net))[0].select("node_id", "x", "y")


@_query(_base() + ", t AS (SELECT max(edge_id) + 1 AS m FROM edges), h AS (SELECT max(id) + 1 AS b FROM nodes) SELECT edge_id, u, v FROM edges UNION ALL SELECT m + id, id, b + id FROM nodes, t, h WHERE id % 10 = 0")
def add_edges(spark, sf_dir):
    net = network(spark, sf_dir)
    return build.add_edges(net.nodes, net.edges, _spurs(net))[1].select("edge_id", "u", "v")


def _spurs(net: SpatialNetwork) -> DataFrame:
    """A short new edge from every tenth node to a node that isn't there yet."""
    top = net.edges.agg(F.max("edge_id") + 1).first()[0]
    base = net.nodes.agg(F.max("node_id") + 1).first()[0]
    s = net.nodes.where("node_id % 10 = 0").select((F.col("node_id") + top).alias("edge_id"), F.col("node_id").alias("u"), (F.col("node_id") + base).alias("v"), G.line(G.point("x", "y"), G.point(F.col("x") + 10, F.col("y") + 10)).alias("geom"))
    return s.select("edge_id", "u", "v", G.length(F.col("geom")).alias("len"), G.length(F.col("geom")).alias("len_r"), F.lit(1.0).alias("weight"), "geom")


@_query(_base() + " SELECT entry_id, edge_id, round(pos_o, 4) AS pos_o FROM snapped WHERE entry_id % 7 <> 0 UNION ALL SELECT entry_id + 10000000, edge_id, round(pos_o, 4) FROM snapped WHERE entry_id % 11 = 0")
def change_entries(spark, sf_dir):
    """Every seventh entry removed, copies of every eleventh added; entries without a place aren't added."""
    e = network(spark, sf_dir).entries
    more = e.where("entry_id % 11 = 0").withColumn("entry_id", F.col("entry_id") + 10_000_000)
    out = build.add_entries(build.remove_entries(snap.mapped(e), e.where("entry_id % 7 = 0").select("entry_id")), more)
    return out.select("entry_id", "edge_id", _r("pos_o"))


@_query(_base() + " SELECT a.edge_id, round(sqrt((a.ax - a.bx) * (a.ax - a.bx) + (a.ay - a.yb) * (a.ay - a.yb) + (a.u % 7 - a.v % 7) * (a.u % 7 - a.v % 7)), 4) AS dist FROM edges a")
def node_distance_3d(spark, sf_dir):
    """Straight distances of the ends of edges, at heights of 0 to 6."""
    net = network(spark, sf_dir)
    at = lambda k: shuffled(net.nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")))
    d = net.edges.select("edge_id", "u", "v").join(at("u"), "u").join(at("v"), "v")
    return d.select("edge_id", F.round(G.euclid3("ux", "uy", F.col("u") % 7, "vx", "vy", F.col("v") % 7), 4).alias("dist"))


_FILES = " SELECT edge_id, round(len, 4) AS len FROM edges"


@_query(_base() + _FILES)
def csv_round_trip(spark, sf_dir):
    """Edges written as CSV with WKT and read back as lines."""
    path = scratch(spark, "csv")
    readers.write_table(network(spark, sf_dir).edges.select("edge_id", "geom"), path, "csv")
    d = prepare.explode_multilines(readers.read_lines(spark, path, "csv", wkt="geom"))
    return d.select(F.col("edge_id").cast("long").alias("edge_id"), F.round(G.length(F.col("geom")), 4).alias("len"))


@_query(_base() + _FILES)
def geojson_round_trip(spark, sf_dir):
    """Edges written as lines of GeoJSON features and read back."""
    path = scratch(spark, "geojson")
    readers.geojson_rows(network(spark, sf_dir).edges.select("edge_id", "geom")).write.text(path)
    d = readers.read_geojson_lines(spark, path).select(F.col("properties")["edge_id"].cast("long").alias("edge_id"), "parts")
    return prepare.explode_multilines(d).select("edge_id", F.round(G.length(F.col("geom")), 4).alias("len"))


@_query(_od_sql(500.0) + "SELECT o, count(*) AS r FROM odw GROUP BY o")
def saved_network_reach(spark, sf_dir):
    """Reach on a network that was saved and loaded."""
    net, path = network(spark, sf_dir), scratch(spark, "network")
    readers.save_network(net.nodes, net.edges, net.entries, path)
    again = SpatialNetwork(*readers.load_network(spark, path))
    return again.reach(_ids(again, "origin"), _ids(again, "dest"), "N", ReachOptions(limit=500.0))


@_query(_base() + ", j AS (SELECT id, count(*) AS c FROM (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) GROUP BY id) SELECT id AS node_id, CASE WHEN c = 1 THEN 255 ELSE 0 END AS r, CASE WHEN c = 1 THEN 0 ELSE 255 END AS b, CAST(c AS VARCHAR) AS label FROM j")
def junction_layer(spark, sf_dir):
    return network(spark, sf_dir).junction_layer().select("node_id", "color.r", "color.b", "label")


@_query(_base() + _breaks(4) + " SELECT edge_id, round(1.0 + s * 4.0, 4) AS width, format('{:,.1f}', len * 100) AS label FROM z JOIN edges USING (edge_id)")
def attribute_layer(spark, sf_dir):
    """Widths and labels of edges by a hundred times their length, so that labels have thousands."""
    net = network(spark, sf_dir)
    out = net.attribute_layer(net.edges.select("edge_id", (F.col("len") * 100).alias("cm")), "cm", distribution="quantile")
    return out.select("edge_id", _r("width"), "label")


@_query(_area_sql(False) + "SELECT o, edge_id, round(vector, 4) AS vector, '#ff0000' AS hex FROM area")
def service_area_layer(spark, sf_dir):
    net = network(spark, sf_dir)
    return net.area_layers(_ids(net, "origin"), 350.0)["edges"].select("o", "edge_id", _r("vector"), "hex")


@_query(_base() + " SELECT entry_id, px AS x, py AS y, 2.0::DOUBLE AS z FROM entries")
def raised_points(spark, sf_dir):
    p = network(spark, sf_dir).entries.select("entry_id", style.raised(G.point("x", "y")).alias("p"))
    return p.select("entry_id", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
