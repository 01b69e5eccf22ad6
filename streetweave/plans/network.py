"""The network facade. It holds DataFrames and never changes them; every query returns a new one."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.functions import style
from streetweave.operators import build, distance, metrics, paths, prepare, service, snap
from streetweave.plans.options import BetweennessBatchOptions, BetweennessOptions, ReachBatchOptions, ReachOptions, SessionOptions, StraightnessOptions
from streetweave.runtime import cut, shuffled


class SpatialNetwork:
    """Nodes, edges and snapped entries.

    nodes: node_id, x, y, weight, cost; edges: edge_id, u, v, len, len_r, weight, geom; entries: entry_id, attributes, edge_id,
    snap_dist, pos_o, pos_d, ix, iy."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, entries: DataFrame):
        self.nodes, self.edges, self.entries = nodes, edges, entries

    @classmethod
    def from_lines(cls, lines: DataFrame, entries: DataFrame, options: SessionOptions | None = None, lines_epsg: int | None = None, entries_epsg: int | None = None) -> SpatialNetwork:
        """lines (edge id, geom or parts, attributes), entries (entry id, x and y or point, attributes). All faults are named in one error."""
        o = options or SessionOptions()
        faults = []
        if "geom" not in lines.columns and "parts" not in lines.columns:
            faults.append("lines need a column geom (a line) or parts (lines)")
        if not {"x", "y"} <= set(entries.columns):
            faults.append("entries need the columns x and y")
        if lines_epsg != entries_epsg:
            faults.append(f"lines and entries are in different projections: {lines_epsg}, {entries_epsg}")
        if lines_epsg in (4326, 4979, 4269):
            faults.append("a projected system is needed, with plane coordinates")
        faults += [f"there is no column {c}" for c in (o.len_col, o.len_r_col, o.weight_col, o.edge_cost) if c and c not in lines.columns]
        if faults:
            raise ValueError("; ".join(faults))
        if "geom" not in lines.columns:
            lines = prepare.explode_multilines(lines)
            lines = lines.drop(o.edge_id)  # parts are edges of their own
        lines = prepare.flatten_lines(lines)
        lines = lines.withColumnRenamed(o.edge_id, "edge_id") if o.edge_id in lines.columns else lines
        entries = entries.withColumnRenamed(o.entry_id, "entry_id") if o.entry_id in entries.columns else entries
        lines, entries = build.with_ids(lines, "edge_id"), build.with_ids(entries, "entry_id")
        if o.segment:
            lines = prepare.segment_intersections(lines)
            lines = build.with_ids(lines.withColumnRenamed("edge_id", "line_id"), "edge_id", [F.col("line_id"), F.col("piece")])
        nodes, edges = build.build_graph(lines, o.digits, o.len_col, o.len_r_col, o.weight_col, o.tolerance)
        nodes, edges = cut(nodes), cut(edges)
        build.check_costs(edges)
        if build.dead_end_ratio(edges).first()["needs_segmenting"]:
            warnings.warn("over 30 % of the nodes are dead ends; lines may need cutting at intersections (segment=True)", stacklevel=2)
        cost = lines.select("edge_id", o.edge_cost) if o.edge_cost else None
        with_cost = edges.join(shuffled(cost), "edge_id") if cost is not None else edges
        return cls(nodes, edges, cut(snap.snap_entries(entries, with_cost, o.entry_reach, o.edge_cost)))

    @cached_property
    def arcs(self) -> DataFrame:
        return distance.weighted_arcs(self.edges, self.nodes)

    def _ends(self, ids: Sequence[int] | DataFrame | None, where: Column | None = None) -> DataFrame:
        e = self.entries if where is None else self.entries.where(where)
        if ids is not None:
            wanted = ids if isinstance(ids, DataFrame) else self.entries.sparkSession.createDataFrame([(int(i),) for i in ids], "entry_id long")
            e = e.join(wanted.select("entry_id").distinct(), "entry_id", "left_semi")
        return distance.with_ends(e, self.edges)

    def labels(self, origins: DataFrame, limit: float, together: bool = False) -> DataFrame:
        return distance.bounded_labels(self.arcs, distance.entry_seeds(origins, together), limit)

    def od(self, origins=None, dests=None, limit: float = 1200.0) -> DataFrame:
        """(o, d, pth, fly, same_edge). origins, dests: ids, or a table of entry_id; all entries by default."""
        o, d = cut(self._ends(origins)), cut(self._ends(dests))
        return distance.od_distances(self.labels(o, limit), o, d, limit)

    def entry_distance(self, origin: int, dest: int, limit: float = 10_000.0) -> DataFrame:
        """One row (o, d, pth, fly, same_edge) for a pair of entries, or none beyond the limit."""
        return self.od([origin], [dest], limit)

    def entry_paths(self, origin: int, dest: int, options: BetweennessOptions | None = None) -> DataFrame:
        """Routes (o, d, length, edges) of a pair of entries, of all weights."""
        o = options or BetweennessOptions()
        src, dst = cut(self._ends([origin])), cut(self._ends([dest]))
        return paths.enumerate_paths(self.arcs, self.labels(src, o.limit * o.detour), src, dst, o.limit, o.detour, not (o.true_paths or o.singular), o.path_limit)

    def node_routes(self, pairs: DataFrame, limit: float = 10_000.0, detour: float = 1.1, path_limit: int | None = None) -> DataFrame:
        """pairs (src, dst) of nodes -> (src, dst, length, edges), all routes within `detour` of the shortest."""
        return paths.enumerate_node_paths(self.arcs, pairs, limit, detour, path_limit)

    def _weights(self, column: str) -> DataFrame:
        w = F.col(column).cast("double") if column in self.entries.columns else F.lit(1.0)
        return self.entries.select(F.col("entry_id").alias("d"), w.alias("w"))

    def reach(self, origins=None, dests=None, mode: str = "N", options: ReachOptions | None = None) -> DataFrame:
        """(o, r[, r_d][, r_w]) of the origins that reach a destination."""
        o = options or ReachOptions()
        return metrics.reach(self.od(origins, dests, o.limit), self._weights(o.weight), mode, o.limit, o.exponent, o.compound)

    def reach_column(self, origins=None, dests=None, mode: str = "N", options: ReachOptions | None = None) -> DataFrame:
        """The entries with result columns: result, result_D, result_W; for ND the least distance is in result_W. 0 where nothing is reached."""
        o = options or ReachOptions()
        r = self.reach(origins, dests, mode, o).withColumnRenamed("r", o.result)
        r = r.withColumnRenamed("r_w", f"{o.result}_W").withColumnRenamed("r_d", f"{o.result}_W" if mode == "ND" else f"{o.result}_D")
        return metrics.fill(self.entries, "entry_id", r, "o")

    def straightness(self, origins=None, dests=None, options: StraightnessOptions | None = None) -> DataFrame:
        o = options or StraightnessOptions()
        return metrics.straightness(self.od(origins, dests, o.limit), self._weights(o.weight), o.limit, o.exponent)

    def routes(self, origins=None, dests=None, options: BetweennessOptions | None = None) -> DataFrame:
        """(o, d, length, edges) of entries of positive weight."""
        o = options or BetweennessOptions()
        positive = lambda c: F.col(c) > 0 if c in self.entries.columns else None
        src, dst = cut(self._ends(origins, positive(o.origin_weight))), cut(self._ends(dests, positive(o.dest_weight)))
        lab = self.labels(src, o.limit * o.detour)
        return paths.enumerate_paths(self.arcs, lab, src, dst, o.limit, o.detour, not (o.true_paths or o.singular), o.path_limit)

    def traffic(self, origins=None, dests=None, options: BetweennessOptions | None = None) -> DataFrame:
        o = options or BetweennessOptions()
        a = self._weights(o.origin_weight).select(F.col("d").alias("o"), F.col("w").alias("a"))
        return metrics.path_traffic(self.routes(origins, dests, o), a, self._weights(o.dest_weight), o.alpha)

    def betweenness(self, origins=None, dests=None, options: BetweennessOptions | None = None, destinations: bool = False):
        """(edge_id, betweenness), or with `destinations` a pair of that and (d, patronage)."""
        t = self.traffic(origins, dests, options)
        if not destinations:
            return metrics.edge_traffic(t)
        t = cut(t)
        return metrics.edge_traffic(t), metrics.destination_traffic(t)

    def service_area(self, origins=None, limit: float = 800.0, joined: bool = False, geometry: bool = False) -> DataFrame:
        """(o, edge_id, vector[, geom]); joined: of all origins together, as o 0."""
        o = cut(self._ends(origins))
        key = F.lit(0).cast("long") if joined else F.col("entry_id")
        area = service.service_area(self.labels(o, limit, joined), self.edges, limit, o.select(key.alias("o"), "edge_id"), self.nodes)
        return service.area_geometry(area, self.edges) if geometry else area

    def service_nodes(self, origins=None, limit: float = 800.0, joined: bool = False) -> DataFrame:
        return service.node_reach(self.labels(cut(self._ends(origins)), limit, joined), self.nodes, limit)

    def reach_aggregate(self, specs: Sequence[tuple], origin_field: str, dest_field: str, options: ReachBatchOptions | None = None) -> DataFrame:
        """specs: (origin value, destination value, distance, weight column or None). Entries with a column for each destination value,
        prefix + value + suffix: the count, and for modes with more, _D and _W. A later spec of one name overwrites its origins' values.

        One expansion at the largest distance serves all specs; each spec holds the pairs to its own distance and gate."""
        o = options or ReachBatchOptions()
        spark = self.entries.sparkSession
        widest = max(float(s[2]) for s in specs)
        kind = lambda c: F.col(c).cast("string")
        wanted = spark.createDataFrame([(i, str(s[0]), str(s[1]), float(s[2])) for i, s in enumerate(specs)], "spec int, ov string, dv string, far double")
        src = cut(self._ends(None, kind(origin_field).isin([str(s[0]) for s in specs])))
        dst = cut(self._ends(None, kind(dest_field).isin([str(s[1]) for s in specs])))
        od = distance.od_distances(self.labels(src, widest), src, dst, widest)
        od = od.join(src.select(F.col("entry_id").alias("o"), kind(origin_field).alias("ov")), "o").join(dst.select(F.col("entry_id").alias("d"), kind(dest_field).alias("dv")), "d")
        od = cut(od.join(F.broadcast(wanted), ["ov", "dv"]).where(((F.col("pth") <= F.col("far")) | F.col("same_edge")) & (F.col("fly") * 1.1 <= F.col("far"))))
        out, done = self.entries, {}
        for i, s in enumerate(specs):
            r = metrics.reach(od.where(F.col("spec") == i), self._weights(s[3] if s[3] is not None else ""), o.mode, float(s[2]), o.exponent, o.compound)
            name = f"{o.prefix}{s[1]}{o.suffix}"
            names = {"r": name, "r_w": f"{name}_W", "r_d": f"{name}_W" if o.mode == "ND" else f"{name}_D"}
            r = r.select("o", *[F.col(c).alias(f"_{names[c]}") for c in r.columns if c != "o"])
            own = src.where(kind(origin_field) == str(s[0])).select(F.col("entry_id").alias("o"), F.lit(True).alias("_own"))
            out = out.join(own.join(r, "o", "left").withColumnRenamed("o", "_o"), F.col("entry_id") == F.col("_o"), "left")
            for c in [c for c in r.columns if c != "o"]:
                before = F.col(c[1:]) if c[1:] in done else F.lit(0.0)
                out = out.withColumn(c[1:], F.when(F.col("_own"), F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(before))
                done[c[1:]] = True
            out = out.drop("_o", "_own", *[c for c in r.columns if c != "o"])
        return out

    def scaled_weights(self, type_field: str, rules: Sequence[tuple]) -> SpatialNetwork:
        """rules: (type value, base weight column, {new column: multiplier}). Each new column is base times multiplier for entries of
        the type, 0 for others without a rule."""
        columns: dict[str, Column] = {}
        for value, base, multipliers in rules:
            for name, m in multipliers.items():
                columns[name] = F.when(F.col(type_field).cast("string") == str(value), F.col(base) * F.lit(float(m))).otherwise(columns.get(name, F.lit(0.0)))
        return SpatialNetwork(self.nodes, self.edges, self.entries.withColumns(columns))

    def betweenness_aggregate(self, pairs: Sequence[tuple], options: BetweennessBatchOptions | None = None) -> DataFrame:
        """pairs: (name, origin weight column, destination weight column[, distance[, detour[, alpha[, -, -, path limit]]]]).
        Edges (edge_id) with a column for each name, prefix + name + suffix, made distinct by _1, _2; 0 without traffic."""
        o = options or BetweennessBatchOptions()
        out = self.edges.select("edge_id")
        for p in pairs:
            p = [*p, *[None] * 9]
            name, n = f"{o.prefix}{p[0]}{o.suffix}", 0
            while (column := name if not n else f"{name}_{n}") in out.columns:
                n += 1
            own = BetweennessOptions(limit=o.limit if p[3] is None else float(p[3]), detour=o.detour if p[4] is None else float(p[4]), alpha=o.alpha if p[5] is None else float(p[5]), path_limit=o.path_limit if p[8] is None else int(p[8]), origin_weight=p[1], dest_weight=p[2])
            out = metrics.fill(out, "edge_id", self.betweenness(options=own).withColumnRenamed("betweenness", column).withColumnRenamed("edge_id", "e"), "e")
        return out

    def without_edges(self, ids: DataFrame) -> SpatialNetwork:
        """The network without the edges of `ids` (edge_id); entries on them stay, without a place on it."""
        nodes, edges = build.remove_edges(self.nodes, self.edges, ids)
        gone = ids.select("edge_id").distinct().withColumn("_gone", F.lit(True))
        entries = self.entries.join(shuffled(gone), "edge_id", "left")
        lost = ("edge_id", "snap_dist", "pos_o", "pos_d", "ix", "iy", "edge_cost")
        kept = [F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in lost else F.col(c) for c in self.entries.columns]
        return SpatialNetwork(nodes, edges, entries.select(*kept))

    def size_info(self) -> DataFrame:
        return build.size_info(self.nodes, self.edges, snap.mapped(self.entries))

    def junctions(self) -> DataFrame:
        """Nodes with junct_cnt."""
        return self.nodes.join(shuffled(build.junction_counts(self.edges)), "node_id")

    def layers(self) -> dict[str, DataFrame]:
        """Map layers: the network, lines from entries to their places on it, the entries, and the centre."""
        connect = snap.mapped(self.entries).select("entry_id", G.line(G.point("x", "y"), G.point("ix", "iy")).alias("geom"))
        centre = self.nodes.agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        return {"network": self.edges.select("edge_id", "geom"), "connectors": connect, "entries": self.entries.select("entry_id", "x", "y"), "centre": centre}

    def attribute_layer(self, result: DataFrame, value: str, palette: str = "viridis", distribution: str = "decile", width: tuple[float, float] = (1.0, 5.0)) -> DataFrame:
        """Edges with a result (edge_id, value) as map rows: geom, colour, hex, width, label and the label's place."""
        d = self.edges.select("edge_id", "geom").join(shuffled(result.select("edge_id", F.col(value).cast("double").alias("value"))), "edge_id")
        d = style.value_ramp(style.color_ramp(d, "value", "color", palette, distribution=distribution), "value", "width", omin=width[0], omax=width[1], distribution=distribution)
        return d.withColumn("hex", style.hex_color(F.col("color"))).withColumn("label", style.number_label(F.col("value"))).withColumn("label_at", G.midpoint(F.col("geom")))

    def junction_layer(self) -> DataFrame:
        """Nodes as map rows: red for dead ends, blue for others, with the number of edge ends as label."""
        return self.junctions().withColumn("color", style.red_blue(F.col("junct_cnt") == 1)).withColumn("label", F.col("junct_cnt").cast("string"))

    def area_layers(self, origins=None, limit: float = 800.0, joined: bool = False) -> dict[str, DataFrame]:
        """Map rows of a service area: its parts of edges with their cover, the nodes within it, and its origins, each with hex and label."""
        red = style.hex_color(style.red_blue(F.lit(True)))
        blue = style.hex_color(style.red_blue(F.lit(False)))
        area = self.service_area(origins, limit, joined, geometry=True)
        label = style.number_label(F.abs("vector") * 100)
        edges = area.withColumn("hex", red).withColumn("label", label)
        nodes = self.service_nodes(origins, limit, joined).withColumn("hex", blue).withColumn("label", style.number_label(F.col("dist")))
        own = self._ends(origins).select("entry_id", "x", "y").withColumn("hex", blue).withColumn("label", F.col("entry_id").cast("string"))
        return {"edges": edges, "nodes": nodes, "origins": own}

    @staticmethod
    def drop_layer(layers: dict[str, DataFrame], which: str | int) -> dict[str, DataFrame]:
        """The layers without the one of a name or a place (from 0, or from the end if negative); an unknown one raises."""
        name = which if isinstance(which, str) else list(layers)[which]
        if name not in layers:
            raise KeyError(name)
        return {n: d for n, d in layers.items() if n != name}

    def register(self, prefix: str = "net_") -> None:
        """Temporary views for SQL: nodes, edges, entries, arcs."""
        for name in ("nodes", "edges", "entries", "arcs"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
