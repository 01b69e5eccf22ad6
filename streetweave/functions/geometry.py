"""Geometry as column expressions. A line is ARRAY<STRUCT<x, y>>, a point STRUCT<x, y>; units are those of the projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def line(*points: Column) -> Column:
    return F.array(*points)


def euclid(ax, ay, bx, by) -> Column:
    """Plane distance of two points."""
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def euclid3(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = _c(ax) - _c(bx), _c(ay) - _c(by), _c(az) - _c(bz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def flatten(geom: Column) -> Column:
    """Without z."""
    return F.transform(geom, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(geom: Column) -> Column:
    """ARRAY<STRUCT<seg, ax, ay, bx, by, len, at>>: a line's pieces with two ends, and where each starts along the line."""
    n = F.size(geom)
    raw = F.transform(F.slice(geom, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: let(F.get(geom, i + 1), lambda q: F.struct(i.alias("seg"), p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"), euclid(p["x"], p["y"], q["x"], q["y"]).alias("len"))))

    def with_offsets(pieces: Column) -> Column:
        offsets = F.aggregate(pieces, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["len"])))
        return F.zip_with(pieces, F.slice(offsets, 1, F.size(pieces)), lambda s, o: F.struct(*[s[c].alias(c) for c in ("seg", "ax", "ay", "bx", "by", "len")], o.alias("at")))

    return let(raw, with_offsets)


def length(geom: Column) -> Column:
    """Length along the line."""
    return F.aggregate(
        F.slice(geom, 2, F.greatest(F.size(geom) - 1, F.lit(0))),
        F.struct(F.lit(0.0).alias("d"), F.get(geom, F.lit(0))["x"].alias("x"), F.get(geom, F.lit(0))["y"].alias("y")),
        lambda acc, p: F.struct((acc["d"] + euclid(acc["x"], acc["y"], p["x"], p["y"])).alias("d"), p["x"].alias("x"), p["y"].alias("y")),
        lambda acc: acc["d"],
    )


def project_t(px, py, ax, ay, bx, by) -> Column:
    """Where on a segment, 0 to 1, the nearest point lies."""
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    n = dx * dx + dy * dy
    t = ((_c(px) - _c(ax)) * dx + (_c(py) - _c(ay)) * dy) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def _place(segs: Column, at: Column) -> Column:
    """The point at a distance along the line of these segments."""

    def on(s: Column) -> Column:
        t = F.when(s["len"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - s["at"]) / s["len"])))
        return let(t, lambda t: F.struct((s["ax"] + (s["bx"] - s["ax"]) * t).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * t).alias("y")))

    return let(F.element_at(F.filter(segs, lambda s: s["at"] <= F.greatest(at, F.lit(0.0))), -1), on)


def interpolate(geom: Column, at: Column) -> Column:
    """The point at a distance along the line, held to its ends."""
    return let(segments(geom), lambda segs: _place(segs, at))


def sub_line(geom: Column, start: Column, end: Column) -> Column:
    """The part of a line between two distances along it."""

    def part(segs: Column) -> Column:
        inner = F.transform(F.filter(segs, lambda s: (s["at"] > start) & (s["at"] < end)), lambda s: F.struct(s["ax"].alias("x"), s["ay"].alias("y")))
        return F.concat(F.array(_place(segs, start)), inner, F.array(_place(segs, end)))

    return let(segments(geom), part)


def part_by_vector(geom: Column, vector: Column) -> Column:
    """The part that a signed fraction names: from the start if positive, the last part if negative."""
    piece = let(length(geom), lambda n: sub_line(geom, F.when(vector >= 0, F.lit(0.0)).otherwise((1 + vector) * n), F.when(vector >= 0, vector * n).otherwise(n)))
    return F.when(F.abs(vector) >= 1, geom).otherwise(piece)


def extend(geom: Column, distance) -> Column:
    """Both ends moved outward along their directions."""
    d = _c(distance)
    n = F.size(geom)

    def outward(a: Column, b: Column) -> Column:
        run = euclid(a["x"], a["y"], b["x"], b["y"])
        f = F.when(run == 0, F.lit(0.0)).otherwise(d / run)
        return F.struct((a["x"] + (a["x"] - b["x"]) * f).alias("x"), (a["y"] + (a["y"] - b["y"]) * f).alias("y"))

    first = outward(F.get(geom, F.lit(0)), F.get(geom, F.lit(1)))
    last = outward(F.get(geom, n - 1), F.get(geom, n - 2))
    return F.concat(F.array(first), F.slice(geom, 2, F.greatest(n - 2, F.lit(0))), F.array(last))


def bbox(geom: Column, pad: float = 0.0) -> Column:
    xs, ys = F.transform(geom, lambda p: p["x"]), F.transform(geom, lambda p: p["y"])
    return F.struct((F.array_min(xs) - pad).alias("x0"), (F.array_min(ys) - pad).alias("y0"), (F.array_max(xs) + pad).alias("x1"), (F.array_max(ys) + pad).alias("y1"))


def bbox_overlap(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def midpoint(geom: Column) -> Column:
    return let(length(geom) / 2, lambda at: interpolate(geom, at))


def centroid(geom: Column) -> Column:
    """Of the line's length: its pieces' midpoints, weighted by length."""
    segs = segments(geom)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        segs,
        zero,
        lambda acc, s: F.struct((acc["n"] + s["len"]).alias("n"), (acc["x"] + s["len"] * (s["ax"] + s["bx"]) / 2).alias("x"), (acc["y"] + s["len"] * (s["ay"] + s["by"]) / 2).alias("y")),
        lambda acc: F.struct((acc["x"] / acc["n"]).alias("x"), (acc["y"] / acc["n"]).alias("y")),
    )


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The grid cells that a box touches, for `explode`."""
    cx = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    cy = F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.flatten(F.transform(cx, lambda i: F.transform(cy, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def to_wkt(geom: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(geom, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """LINESTRING or MULTILINESTRING text to ARRAY<line>, z dropped; null for anything else."""
    body = F.regexp_replace(F.upper(F.trim(text)), "^(MULTI)?LINESTRING\\s*(Z|M|ZM)?\\s*", "")
    parts = F.split(F.regexp_replace(body, "^\\(+|\\)+$", ""), "\\)\\s*,\\s*\\(")

    def points(part: Column) -> Column:
        return F.transform(F.split(F.trim(part), "\\s*,\\s*"), lambda p: F.struct(F.split(p, "\\s+")[0].cast("double").alias("x"), F.split(p, "\\s+")[1].cast("double").alias("y")))

    return F.when(F.upper(F.trim(text)).rlike("^(MULTI)?LINESTRING"), F.transform(parts, points))


def point_from_wkt(text: Column) -> Column:
    body = F.split(F.regexp_replace(F.upper(F.trim(text)), "^POINT\\s*(Z|M|ZM)?\\s*\\(|\\)$", ""), "\\s+")
    return F.when(F.upper(F.trim(text)).startswith("POINT"), point(body[0], body[1]))
