"""Values to colours, widths and labels for maps, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seven steps of the two colour scales, from low to high, as red, green, blue.
PALETTES = {
    "viridis": [(68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (53, 183, 121), (253, 231, 37)],
    "spectral": [(50, 12, 105), (43, 131, 186), (171, 221, 164), (253, 174, 97), (244, 109, 67), (213, 62, 79), (158, 1, 66)],
}
RGB = "struct<r:int,g:int,b:int>"


def stretch(df: DataFrame, value: str, out: str, vmin: float | None = None, vmax: float | None = None, distribution: str = "decile") -> DataFrame:
    """Adds `out`, 0 to 1: the value's place between the breaks of the distribution (decile, quantile: quarters) or between its ends (linear).

    Breaks are exact percentiles of the held values, one scalar value. Nulls stay null."""
    parts = {"decile": 10, "quantile": 4, "linear": 1}[distribution]
    v = F.col(value).cast("double")
    held = v
    if vmin is not None:
        held = F.greatest(held, F.lit(float(vmin)))
    if vmax is not None:
        held = F.least(held, F.lit(float(vmax)))
    held = F.when(v.isNotNull(), held)
    breaks = df.agg(F.percentile(held, F.array(*[F.lit(k / parts) for k in range(parts + 1)])).alias("breaks"))
    d = df.withColumn("_v", held).withColumn("_breaks", breaks.scalar())
    b = F.col("_breaks")
    k = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.size(F.filter(b, lambda x: x <= F.col("_v"))) - 1))
    lo, hi = F.get(b, k), F.get(b, k + 1)
    inside = F.when(hi > lo, (F.col("_v") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    # Values and breaks may come from two evaluations of a sum, whose last digits differ; so a value can lie just outside the breaks.
    return d.withColumn(out, F.when(F.col("_v").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k + inside) / parts)))).drop("_breaks", "_v")


def color_ramp(df: DataFrame, value: str, out: str = "color", palette: str | Sequence[tuple[int, int, int]] = "viridis", vmin: float | None = None, vmax: float | None = None, distribution: str = "decile") -> DataFrame:
    """Adds a colour between the palette's steps; nulls take the first."""
    steps = PALETTES.get(palette.lower(), PALETTES["viridis"]) if isinstance(palette, str) else list(palette)
    d = stretch(df, value, "_s", vmin, vmax, distribution)
    place = F.coalesce(F.col("_s"), F.lit(0.0)) * (len(steps) - 1)
    k = F.least(F.floor(place), F.lit(len(steps) - 2)).cast("int")
    f = place - k

    def channel(c: int) -> Column:
        table = F.array(*[F.lit(float(s[c])) for s in steps])
        return F.floor(F.get(table, k) + (F.get(table, k + 1) - F.get(table, k)) * f).cast("int")

    return d.withColumn(out, F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))).drop("_s")


def value_ramp(df: DataFrame, value: str, out: str = "width", vmin: float | None = None, vmax: float | None = None, omin: float = 1.0, omax: float = 5.0, distribution: str = "decile") -> DataFrame:
    """Adds a number from omin to omax; nulls take omin."""
    d = stretch(df, value, "_s", vmin, vmax, distribution)
    return d.withColumn(out, F.lit(float(omin)) + F.coalesce(F.col("_s"), F.lit(0.0)) * F.lit(float(omax - omin))).drop("_s")


def hex_color(c: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c[k].cast("long")), 2, "0") for k in ("r", "g", "b")]))


def red_blue(flag: Column) -> Column:
    """Red where true, blue where not."""
    pick = lambda a, b: F.when(flag, F.lit(a)).otherwise(F.lit(b))
    return F.struct(pick(255, 0).alias("r"), F.lit(0).alias("g"), pick(0, 255).alias("b"))


def rgb_only(c: Column) -> Column:
    """The first three channels of an array as a colour."""
    return F.struct(*[F.get(c, F.lit(i)).cast("int").alias(k) for i, k in enumerate("rgb")])


def number_label(v: Column, digits: int = 1) -> Column:
    return F.format_number(v, digits)


def raised(p: Column, z: float = 2.0) -> Column:
    """(x, y, z) of a point, lifted."""
    return F.array(p["x"], p["y"], F.lit(float(z)))
