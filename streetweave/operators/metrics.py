"""Accessibility and flow metrics: aggregations over pairs and routes. `od` has o, d, pth, fly; `weights` d, w."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("N", "W", "WD", "ND", "NDW")


def decay(limit: float, exponent: float, rank: Column | None = None, compound: float = 1.0) -> Column:
    """The factor on a destination's weight at distance pth. rank: 0 for the nearest, compounds by compound ** rank."""
    x = F.col("pth") / F.lit(float(limit))
    c = F.pow(F.lit(float(compound)), rank) if rank is not None else F.lit(1.0)
    e = F.lit(float(exponent))
    if exponent == 0:
        return (1 - x) * c
    return F.exp(e * x) * (1 - x) * c if exponent < 0 else x * F.exp(e * (x - 1) * c)


def reach(od: DataFrame, weights: DataFrame, mode: str, limit: float, exponent: float = 0.35, compound: float = 0.6) -> DataFrame:
    """(o, r[, r_d][, r_w]) of origins that reach something: r the count, r_d the least distance, r_w the weight, or decayed weight (WD).

    Ranks for WD go by distance, then d."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    d = od.join(weights, "d", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    count = F.count("*").alias("r")
    if mode == "WD":
        d = d.withColumn("_k", F.row_number().over(Window.partitionBy("o").orderBy("pth", "d")) - 1)
        term = F.abs(F.col("w") * decay(limit, 0, F.col("_k"), compound)) if exponent == 0 else F.col("w") * decay(limit, exponent, F.col("_k"), compound)
        return d.groupBy("o").agg(count, F.sum(term).alias("r_w"))
    extra = {"N": [], "W": [F.sum("w").alias("r_w")], "ND": [F.min("pth").alias("r_d")], "NDW": [F.min("pth").alias("r_d"), F.sum("w").alias("r_w")]}
    return d.groupBy("o").agg(count, *extra[mode])


def straightness(od: DataFrame, weights: DataFrame, limit: float, exponent: float = 0.35) -> DataFrame:
    """(o, straightness): mean of fly / pth, by decayed weight; 0 where the weights sum to 0 or less."""
    d = od.join(weights, "d", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    wd = F.col("w") if exponent == 0 else F.col("w") * decay(limit, exponent)
    s = d.groupBy("o").agg(F.sum(F.col("fly") / F.col("pth") * wd).alias("a"), F.sum(wd).alias("b"))
    return s.select("o", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("straightness"))


def path_traffic(paths: DataFrame, origin_weights: DataFrame, weights: DataFrame, alpha: float = 0.0) -> DataFrame:
    """paths with traffic: the origin's weight shared over its routes by destination weight times length ** -(1 + alpha).

    Totals of origins come from an aggregation that is joined back, so no task sorts an origin's routes."""
    p = paths.withColumn("length", F.when(F.col("length") == 0, F.lit(0.1)).otherwise(F.col("length")))
    p = p.join(weights, "d", "left").withColumn("share", F.coalesce("w", F.lit(1.0)) * F.pow("length", F.lit(-(1.0 + alpha)))).drop("w")
    total = p.groupBy("o").agg(F.sum("share").alias("total"))
    return p.join(total, "o").join(origin_weights.select("o", "a"), "o").withColumn("traffic", F.when(F.col("total") > 0, F.col("a") * F.col("share") / F.col("total")).otherwise(F.lit(0.0))).drop("share", "total", "a")


def edge_traffic(traffic: DataFrame) -> DataFrame:
    """(edge_id, betweenness)."""
    return traffic.select(F.explode("edges").alias("edge_id"), "traffic").groupBy("edge_id").agg(F.sum("traffic").alias("betweenness"))


def destination_traffic(traffic: DataFrame) -> DataFrame:
    """(d, patronage)."""
    return traffic.groupBy("d").agg(F.sum("traffic").alias("patronage"))


def fill(base: DataFrame, key: str, result: DataFrame, result_key: str) -> DataFrame:
    """`base` with the result's columns, 0 where there is no result."""
    columns = [c for c in result.columns if c != result_key]
    joined = base.join(result.withColumnRenamed(result_key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
