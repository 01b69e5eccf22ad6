"""Nodes, edges and arcs from lines, and changed networks as new values.

edges: edge_id, u, v, len, len_r, weight, geom. nodes: node_id, x, y, weight, cost. arcs: src, dst, edge_id, cost, a row
for each direction of an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.runtime import cut, number_rows, shuffled


def with_ids(df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """`df` with an id column 0, 1, ... if it has none."""
    return df if name in df.columns else number_rows(df, order or [F.col(c) for c in df.columns], name)


def build_graph(lines: DataFrame, digits: int = 3, len_col: str | None = None, len_r_col: str | None = None, weight_col: str | None = None, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (edge_id, geom, ...): ends that agree in `digits` decimals are one node, numbered as first
    seen, in the order of edge_id, start before end. Lengths are geometric unless columns are named; len_r is len unless named.

    tolerance: ends within that distance of one another, also through others, are one node instead, at its first end."""
    g = F.col("geom")
    length = F.col(len_col) if len_col else G.length(g)
    e = lines.select(
        "edge_id",
        "geom",
        length.cast("double").alias("len"),
        (F.col(len_r_col).cast("double") if len_r_col else length).alias("len_r"),
        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("weight"),
        _key(F.get(g, F.lit(0)), digits).alias("a"),
        _key(F.element_at(g, -1), digits).alias("b"),
    )
    if tolerance is not None:
        # An end takes the place of the first end of its group, which all ends of the group then share.
        group = cut(snap_ends(lines.select("edge_id", "geom"), tolerance))
        own = e.select("edge_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("geom")[0].alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("geom", -1).alias("p")))).alias("s")).select("edge_id", "s.end", "s.p")
        place = own.select((F.col("edge_id") * 2 + F.col("end")).alias("group"), F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("at"))
        at_end = lambda end, name: group.where(F.col("end") == end).join(shuffled(place), "group").select("edge_id", F.col("at").alias(name))
        e = e.drop("a", "b").join(shuffled(at_end(0, "a")), "edge_id").join(shuffled(at_end(1, "b")), "edge_id")
    ends = e.select(F.explode(F.array(F.struct("a", F.col("edge_id"), F.lit(0).alias("end")), F.struct(F.col("b").alias("a"), F.col("edge_id"), F.lit(1).alias("end")))).alias("s"))
    first = ends.groupBy(F.col("s.a").alias("key")).agg(F.min(F.struct("s.edge_id", "s.end")).alias("seen"))
    nodes = number_rows(first.select("key", "seen"), [F.col("seen.edge_id"), F.col("seen.end")], "node_id")
    at = nodes.select("key", "node_id")
    edges = e.join(shuffled(at.select(F.col("key").alias("a"), F.col("node_id").alias("u"))), "a").join(shuffled(at.select(F.col("key").alias("b"), F.col("node_id").alias("v"))), "b")
    nodes = nodes.select("node_id", F.col("key.x").alias("x"), F.col("key.y").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("cost"))
    return nodes, edges.select("edge_id", "u", "v", "len", "len_r", "weight", "geom")


def _key(p: Column, digits: int) -> Column:
    return F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))


def snap_ends(lines: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(edge_id, end, group): ends within `tolerance` of one another, also through others, have the smallest (edge_id, end) as group.

    Ends meet in grid cells of the tolerance's size; labels spread until they stay."""
    g = F.col("geom")
    ends = lines.select(F.explode(F.array(F.struct((F.col("edge_id") * 2).alias("p"), F.get(g, F.lit(0)).alias("at")), F.struct((F.col("edge_id") * 2 + 1).alias("p"), F.element_at(g, -1).alias("at")))).alias("e")).select("e.p", "e.at.x", "e.at.y")
    cell = ends.select("*", F.floor(F.col("x") / tolerance).alias("cx"), F.floor(F.col("y") / tolerance).alias("cy"))
    around = cell.select(F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i as cx, cy + j as cy))))")).alias("c")).select("q", "qx", "qy", "c.cx", "c.cy")
    links = cut(cell.join(shuffled(around), ["cx", "cy"]).where(G.euclid("x", "y", "qx", "qy") <= tolerance).select("p", "q").distinct())
    labels = cut(ends.select("p", F.col("p").alias("label")))
    while True:
        spread = links.join(shuffled(labels.select(F.col("p").alias("q"), F.col("label").alias("near"))), "q").groupBy("p").agg(F.min("near").alias("near"))
        nxt = cut(labels.join(shuffled(spread), "p").select("p", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        labels = nxt.select("p", "label")
        if nxt.where("moved").isEmpty():
            return labels.select(F.expr("p div 2").alias("edge_id"), F.expr("p % 2").cast("int").alias("end"), F.col("label").alias("group"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: u to v at len, v to u at len_r."""
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("len").alias("cost")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.col("len_r").alias("cost")))
    return edges.select("edge_id", F.explode(both).alias("a")).select("a.src", "a.dst", "edge_id", "a.cost")


def check_costs(edges: DataFrame) -> None:
    """Distances need costs of zero or more."""
    if not edges.where("len < 0 OR len_r < 0 OR len IS NULL OR len_r IS NULL").isEmpty():
        raise ValueError("edge lengths must be zero or more")


def junction_counts(edges: DataFrame) -> DataFrame:
    """(node_id, junct_cnt): edge ends at each node; a loop counts two."""
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("junct_cnt"))


def dead_end_ratio(edges: DataFrame) -> DataFrame:
    """One row: share of nodes with a single edge end, and whether it calls for segmenting (above 0.3)."""
    d = junction_counts(edges).agg(F.avg((F.col("junct_cnt") == 1).cast("double")).alias("dead_end_ratio"))
    return d.withColumn("needs_segmenting", F.col("dead_end_ratio") > 0.3)


def size_info(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_entries."""
    counts = [d.agg(F.count("*").alias("n")).scalar().alias(n) for d, n in ((nodes, "n_nodes"), (edges, "n_edges"), (entries, "n_entries"))]
    return nodes.sparkSession.range(1).select(*counts)


def remove_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the edges of `ids` (edge_id), and without nodes that are left alone."""
    left = edges.join(shuffled(ids.select("edge_id").distinct()), "edge_id", "left_anti")
    return _touched(nodes, left), left


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of `ids` (node_id), their edges, and nodes that are left alone by that."""
    gone = shuffled(ids.select("node_id").distinct())
    left = edges.join(gone, edges["u"] == gone["node_id"], "left_anti").join(gone, edges["v"] == gone["node_id"], "left_anti")
    return _touched(nodes, left), left


def _touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(shuffled(edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()), "node_id", "left_semi")


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """`more` replaces nodes of its ids and adds the rest."""
    return nodes.join(shuffled(more.select("node_id")), "node_id", "left_anti").unionByName(more)


def add_edges(nodes: DataFrame, edges: DataFrame, more: DataFrame, create_nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges of `more` replace those of their ids and add the rest. With create_nodes, missing ends become nodes at the line's ends;
    without, edges with a missing end are left out."""
    ends = more.select(F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.get("geom", F.lit(0)).alias("p")), F.struct(F.col("v").alias("node_id"), F.element_at("geom", -1).alias("p")))).alias("e"))
    new = ends.groupBy(F.col("e.node_id").alias("node_id")).agg(F.min("e.p").alias("p")).join(shuffled(nodes), "node_id", "left_anti")
    new = new.select("node_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("cost"))
    if create_nodes:
        nodes = nodes.unionByName(new.select(*nodes.columns))
    else:
        more = more.join(shuffled(new.select(F.col("node_id").alias("u"))), "u", "left_anti").join(shuffled(new.select(F.col("node_id").alias("v"))), "v", "left_anti")
    return nodes, edges.join(shuffled(more.select("edge_id")), "edge_id", "left_anti").unionByName(more.select(*edges.columns))


def add_entries(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Snapped entries; those without an edge are left out."""
    more = more.where(F.col("edge_id").isNotNull())
    return entries.join(shuffled(more.select("entry_id")), "entry_id", "left_anti").unionByName(more)


def remove_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(shuffled(ids.select("entry_id").distinct()), "entry_id", "left_anti")


def path_length(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (path_id, edges: ids in order) -> path_id, length: each edge at the cost of the direction in which the next one (or the one
    before) is met; a path of one edge has length 0."""
    steps = paths.select("path_id", F.posexplode("edges").alias("k", "edge_id"))
    steps = steps.join(shuffled(edges.select("edge_id", "u", "v", "len", "len_r")), "edge_id")
    w = Window.partitionBy("path_id").orderBy("k")
    shares = lambda n, a, b: (F.col(n) == a) | (F.col(n) == b)
    s = steps.select("*", F.lead("u").over(w).alias("nu"), F.lead("v").over(w).alias("nv"), F.lag("u").over(w).alias("pu"), F.lag("v").over(w).alias("pv"), F.count("*").over(Window.partitionBy("path_id")).alias("n"))
    forward = F.when(F.col("nu").isNotNull(), shares("v", F.col("nu"), F.col("nv"))).otherwise(shares("u", F.col("pu"), F.col("pv")))
    cost = F.when(F.col("n") == 1, F.lit(0.0)).when(forward, F.col("len")).otherwise(F.col("len_r"))
    return s.groupBy("path_id").agg(F.sum(cost).alias("length"))


def node_path_to_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (path_id, nodes in order) -> path_id, edges: the cheapest edge between each two, then the smallest id; steps without an edge are left out."""
    steps = paths.select("path_id", F.posexplode("nodes").alias("k", "src"))
    steps = steps.withColumn("dst", F.lead("src").over(Window.partitionBy("path_id").orderBy("k"))).where(F.col("dst").isNotNull())
    best = arcs(edges).groupBy("src", "dst").agg(F.min(F.struct("cost", "edge_id")).alias("b"))
    hit = steps.join(shuffled(best), ["src", "dst"])
    return hit.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("b.edge_id").alias("e")))), lambda x: x["e"]).alias("edges"))


def smallest_missing(ids: DataFrame, column: str) -> DataFrame:
    """One row, `missing`: the smallest integer from 0 that isn't there. Ids in order equal their place up to the gap."""
    d = ids.select(F.col(column).cast("long").alias("i")).where("i >= 0").distinct()
    nxt = d.select((F.col("i") + 1).alias("i")).unionByName(ids.sparkSession.range(1).select(F.col("id").alias("i")))
    return nxt.join(shuffled(d), "i", "left_anti").agg(F.min("i").alias("missing"))
