"""A bent street grid from the tables part, supplier and customer, by integer arithmetic, for tests and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.functions import geometry as G

#: Added to customer keys, so that entries of both tables have ids of their own.
DEST_BASE = 1_000_000


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("sz"))
    n = part.count()
    return part, n, math.ceil(math.sqrt(n))


def _x(i: Column, w: int) -> Column:
    return ((i % w) * 100 + (i * 37) % 41 - 20).cast("double")


def _y(i: Column, w: int) -> Column:
    return (F.floor(i / w) * 100 + (i * 53) % 41 - 20).cast("double")


def grid_nodes(spark: SparkSession, sf_dir: str, costs: bool = False) -> DataFrame:
    part, _, w = _grid(spark, sf_dir)
    cost = (F.col("sz") % 5).cast("double") if costs else F.lit(0.0)
    return part.select(F.col("id").alias("node_id"), _x(F.col("id"), w).alias("x"), _y(F.col("id"), w).alias("y"), F.lit(1.0).alias("weight"), cost.alias("cost"))


def grid_edges(spark: SparkSession, sf_dir: str, directed: bool = False) -> DataFrame:
    part, n, w = _grid(spark, sf_dir)
    i = F.col("id")
    right = F.struct((i * 2).alias("edge_id"), (i + 1).alias("v"), ((i % w + 1 < w) & (i + 1 < n) & (F.col("sz") % 7 != 0)).alias("there"))
    up = F.struct((i * 2 + 1).alias("edge_id"), (i + w).alias("v"), (i + w < n).alias("there"))
    e = part.select("id", "sz", F.explode(F.array(right, up)).alias("e")).where("e.there").select("e.edge_id", F.col("id").alias("u"), "e.v", "sz")
    u, v, sz = F.col("u"), F.col("v"), F.col("sz")
    middle = G.point((_x(u, w) + _x(v, w)) / 2 + (sz % 11 - 5), (_y(u, w) + _y(v, w)) / 2 + (sz % 13 - 6))
    e = e.withColumn("geom", G.line(G.point(_x(u, w), _y(u, w)), middle, G.point(_x(v, w), _y(v, w)))).withColumn("len", G.length(F.col("geom")))
    back = F.col("len") * (F.lit(1.0) + F.lit(0.1) * (sz % 3)) if directed else F.col("len")
    return e.select("edge_id", "u", "v", "len", back.alias("len_r"), F.lit(1.0).alias("weight"), "geom")


def diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines across grid cells, both ways: (edge_id, geom). The two of a cell cross."""
    part, n, w = _grid(spark, sf_dir)
    i = F.col("id")
    inside = (i % w + 1 < w) & (i + w + 1 < n)
    a, b = F.struct((i * 2).alias("edge_id"), i.alias("u"), (i + w + 1).alias("v")), F.struct((i * 2 + 1).alias("edge_id"), (i + 1).alias("u"), (i + w).alias("v"))
    d = part.where(inside).select(F.explode(F.array(a, b)).alias("e")).select("e.*")
    return d.select("edge_id", G.line(G.point(_x(F.col("u"), w), _y(F.col("u"), w)), G.point(_x(F.col("v"), w), _y(F.col("v"), w))).alias("geom"))


def grid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, x, y, weight, kind (origin: suppliers, dest: customers), category."""
    w = _grid(spark, sf_dir)[2]
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_acctbal").alias("b"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").alias("b"), "c_mktsegment")
    k = F.col("k")
    weight = F.greatest(F.col("b"), F.lit(0.0)).alias("weight")
    o = s.select(k.alias("entry_id"), ((k * 7919) % (100 * w)).cast("double").alias("x"), ((k * 104729) % (100 * w)).cast("double").alias("y"), weight, F.lit("origin").alias("kind"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("category"))
    d = c.select((k + DEST_BASE).alias("entry_id"), ((k * 7927) % (100 * w)).cast("double").alias("x"), ((k * 104723) % (100 * w)).cast("double").alias("y"), weight, F.lit("dest").alias("kind"), F.col("c_mktsegment").alias("category"))
    return o.unionByName(d)
