"""Network preparation: parts to lines, junctions, cutting at intersections, densifying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.functions import geometry as G
from streetweave.operators.build import with_ids
from streetweave.runtime import cut, maybe_broadcast, shuffled


def explode_multilines(df: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part (array of lines), attributes repeated; part_no counts from 0."""
    return df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part_no", "geom"))


def flatten_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", G.flatten(F.col("geom")))


def extend_lines(df: DataFrame, distance: float) -> DataFrame:
    return df.withColumn("geom", G.extend(F.col("geom"), distance))


def junctions(lines: DataFrame, digits: int = 3) -> DataFrame:
    """(x, y, junct_cnt): line ends rounded to `digits` decimals."""
    g = F.col("geom")
    ends = lines.select(F.explode(F.array(F.get(g, F.lit(0)), F.element_at(g, -1))).alias("p"))
    return ends.groupBy(F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).agg(F.count("*").alias("junct_cnt"))


def mark_dead_ends(lines: DataFrame, digits: int = 3) -> DataFrame:
    """Adds dead_end: whether an end of the line is met by no other line."""
    j = junctions(lines, digits).where("junct_cnt = 1").select(F.struct("x", "y").alias("p"))
    g = F.col("geom")
    round_ = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    ends = lines.select("edge_id", F.explode(F.array(round_(F.get(g, F.lit(0))), round_(F.element_at(g, -1)))).alias("p"))
    dead = ends.join(shuffled(j), "p").select("edge_id").distinct().withColumn("dead_end", F.lit(True))
    return lines.join(shuffled(dead), "edge_id", "left").withColumn("dead_end", F.coalesce("dead_end", F.lit(False)))


def densify(lines: DataFrame, distance: float = 50.0) -> DataFrame:
    """Lines longer than 1.5 times `distance` become round(length / distance) equal pieces; attributes are repeated, piece counts from 0."""
    g, n = F.col("geom"), F.col("_n")
    d = lines.withColumn("_len", G.length(g)).withColumn("_n", F.when(F.col("_len") > 1.5 * distance, F.round(F.col("_len") / distance).cast("int")).otherwise(F.lit(1)))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.when(n == 1, g).otherwise(G.sub_line(g, F.col("_len") * F.col("piece") / n, F.col("_len") * (F.col("piece") + 1) / n))
    return d.withColumn("geom", part).drop("_len", "_n")


def segment_rows(lines: DataFrame) -> DataFrame:
    """(edge_id, seg, ax, ay, bx, by, len, at) of lines (edge_id, geom)."""
    return lines.select("edge_id", F.explode(G.segments(F.col("geom"))).alias("s")).select("edge_id", "s.*")


def overlapping_boxes(lines: DataFrame, pad: float = 1.0, cell: float = 200.0) -> DataFrame:
    """(a, b) with a < b: lines whose padded boxes overlap. Boxes meet in grid cells; a pair counts in the first cell that both touch."""
    b = lines.select("edge_id", G.bbox(F.col("geom"), pad).alias("box"))
    b = b.select("*", F.explode(G.cells(F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1"), cell)).alias("c")).select("edge_id", "box", "c.cx", "c.cy")
    left = b.select("cx", "cy", F.col("edge_id").alias("a"), F.col("box").alias("p"))
    right = b.select("cx", "cy", F.col("edge_id").alias("b"), F.col("box").alias("q"))
    first = (F.col("cx") == F.floor(F.greatest("p.x0", "q.x0") / cell)) & (F.col("cy") == F.floor(F.greatest("p.y0", "q.y0") / cell))
    return left.join(shuffled(right), ["cx", "cy"]).where((F.col("a") < F.col("b")) & G.bbox_overlap(F.col("p"), F.col("q")) & first).select("a", "b")


def intersections(lines: DataFrame, cell: float = 100.0, eps: float = 1e-6) -> DataFrame:
    """(edge_id, at): where along each line another one meets it, strictly inside the line.

    Segments meet in grid cells; parallel segments have no single point and give none."""
    s = segment_rows(lines)
    hit = crossings(s, s.withColumnRenamed("edge_id", "other_id"), "edge_id", "other_id", cell, eps).where("edge_id <> other_id")
    total = s.groupBy("edge_id").agg(F.sum("len").alias("total"))
    hit = hit.select("edge_id", (F.col("at") + F.col("t") * F.col("len")).alias("at")).join(shuffled(total), "edge_id")
    return hit.where((F.col("at") > 1e-3) & (F.col("at") < F.col("total") - 1e-3)).select("edge_id", F.round("at", 3).alias("at")).distinct()


def segment_intersections(lines: DataFrame, extension: float = 0.1, double_pass: bool = False, cell: float = 100.0) -> DataFrame:
    """Lines cut where they meet. Ends are first moved out by `extension`; then first and last pieces shorter than 1.1 times that
    (0.1 without extension) go, and pieces of 0.05 or less. Attributes are repeated, piece counts from 0 along the line.

    double_pass cuts the result once more, without extension, under ids of its own."""
    d = with_ids(lines, "edge_id")
    if extension:
        d = extend_lines(d, extension)
    cuts = intersections(d.select("edge_id", "geom"), cell).groupBy("edge_id").agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    d = d.join(shuffled(cuts), "edge_id", "left").withColumn("_len", G.length(F.col("geom")))
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce("_cuts", F.array().cast("array<double>")), F.array("_len"))
    d = d.withColumn("_stops", stops).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_stops") - 2)))
    lo, hi = F.get("_stops", F.col("_k")), F.get("_stops", F.col("_k") + 1)
    shortest = 1.1 * extension if extension else 0.1
    end = (F.col("_k") == 0) | (F.col("_k") == F.size("_stops") - 2)
    whole = F.size("_stops") == 2
    d = d.where(whole | ((hi - lo > 0.05) & ~(end & (hi - lo < shortest))))
    d = d.withColumn("geom", G.sub_line(F.col("geom"), lo, hi)).withColumn("piece", F.col("_k")).drop("_cuts", "_len", "_stops", "_k")
    if not double_pass:
        return d
    d = d.withColumnRenamed("edge_id", "line_id").withColumnRenamed("piece", "line_piece")
    return segment_intersections(with_ids(d, "edge_id", [F.col("line_id"), F.col("line_piece")]), 0.0, False, cell)


def split_lines(lines: DataFrame, points: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Lines (edge_id, geom) cut at points (edge_id, x, y) that lie within `tolerance` of them: edge_id, piece, geom."""
    s = segment_rows(lines).join(shuffled(points.select("edge_id", F.col("x").alias("px"), F.col("y").alias("py"))), "edge_id")
    t = G.project_t("px", "py", "ax", "ay", "bx", "by")
    s = s.withColumn("t", t).withColumn("d", G.euclid(F.col("px"), F.col("py"), F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))))
    near = s.groupBy("edge_id", "px", "py").agg(F.min(F.struct("d", "seg", (F.col("at") + F.col("t") * F.col("len")).alias("pos"))).alias("m")).where(F.col("m.d") <= tolerance)
    cuts = near.groupBy("edge_id").agg(F.sort_array(F.collect_set("m.pos")).alias("_cuts"))
    d = lines.join(shuffled(cuts), "edge_id", "left").withColumn("_len", G.length(F.col("geom")))
    inner = F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda x: (x > tolerance) & (x < F.col("_len") - tolerance))
    d = d.withColumn("_stops", F.concat(F.array(F.lit(0.0)), inner, F.array("_len"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("_stops") - 2)))
    return d.withColumn("geom", G.sub_line(F.col("geom"), F.get("_stops", F.col("piece")), F.get("_stops", F.col("piece") + 1))).drop("_cuts", "_len", "_stops")


def touch_points(a: DataFrame, b: DataFrame, tolerance: float = 1e-3, cell: float = 100.0) -> DataFrame:
    """(a_id, b_id, x, y): ends of the lines of `b` within `tolerance` of lines of `a`, and the points where lines of both cross, unless
    the same two lines have such an end within `tolerance` of the point. Places are rounded to `tolerance`'s decimals only to tell
    crossings at a bend of a line from one another; parallel segments have no single point and give none."""
    ends = b.select(F.col("edge_id").alias("b_id"), F.explode(F.array(F.get("geom", F.lit(0)), F.element_at("geom", -1))).alias("p")).select("b_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    near = nearby_segments(ends, segment_rows(a), tolerance)
    touching = cut(near.where(F.col("dist") <= tolerance).select(F.col("edge_id").alias("a_id"), "b_id", F.col("px").alias("x"), F.col("py").alias("y")).distinct())
    hit = crossings(segment_rows(a).withColumnRenamed("edge_id", "a_id"), segment_rows(b).withColumnRenamed("edge_id", "b_id"), "a_id", "b_id", cell)
    x, y = F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))
    hit = hit.select("a_id", "b_id", x.alias("x"), y.alias("y"))
    one = hit.groupBy("a_id", "b_id", F.round(F.col("x") / tolerance), F.round(F.col("y") / tolerance)).agg(F.min(F.struct("x", "y")).alias("p")).select("a_id", "b_id", "p.x", "p.y")
    known = touching.select("a_id", "b_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    new = one.join(shuffled(known), (one["a_id"] == known["a_id"]) & (one["b_id"] == known["b_id"]) & (G.euclid("x", "y", "tx", "ty") <= tolerance), "left_anti")
    return touching.unionByName(new)


def crossings(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float = 100.0, eps: float = 1e-6) -> DataFrame:
    """(a_id, b_id, seg's ends of a, at, len, t): pairs of segments (segment_rows under their own id columns) that meet, t along the one of `a`.

    Segments meet in grid cells; a pair that shares several cells has a row for each, alike, for the caller to make distinct."""

    def boxed(s: DataFrame) -> DataFrame:
        box = G.cells(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), cell)
        return s.select("*", F.explode(box).alias("c")).select(*s.columns, "c.cx", "c.cy")

    other = boxed(b).select("cx", "cy", b_id, *[F.col(x).alias(f"o_{x}") for x in ("ax", "ay", "bx", "by")])
    rx, ry = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sx, sy = F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")
    qx, qy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    d = boxed(a).join(shuffled(other), ["cx", "cy"]).withColumn("det", rx * sy - ry * sx).where(F.abs("det") > 1e-12)
    d = d.withColumn("t", (qx * sy - qy * sx) / F.col("det")).withColumn("u", (qx * ry - qy * rx) / F.col("det"))
    d = d.where(F.col("t").between(-eps, 1 + eps) & F.col("u").between(-eps, 1 + eps))
    return d.select(a_id, b_id, "ax", "ay", "bx", "by", "at", "len", "t")


def nearby_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """points (px, py, ...) with the segments up to `reach` away, t and dist: an equi-join on grid cells no smaller than the reach."""
    cell = max(float(reach), 1.0)
    padded = G.cells(F.least("ax", "bx") - reach, F.least("ay", "by") - reach, F.greatest("ax", "bx") + reach, F.greatest("ay", "by") + reach, cell)
    s = segments.select("*", F.explode(padded).alias("c")).select(*segments.columns, "c.cx", "c.cy")
    p = points.select("*", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
    d = maybe_broadcast(p).join(s, ["cx", "cy"]).withColumn("t", G.project_t("px", "py", "ax", "ay", "bx", "by"))
    return d.withColumn("ix", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).withColumn("iy", F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).withColumn("dist", G.euclid("px", "py", "ix", "iy")).where(F.col("dist") <= reach)
