"""Cutting lineage in loops, numbering rows, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, of a few numbers each, up to which a table is broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local one in local mode; elsewhere that raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_streetweave_checkpoints", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="checkpoint-")).as_uri()
        sc.setCheckpointDir(root)
        sc._streetweave_checkpoints = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, marked so that joins shuffle it.

    Spark's estimates start from the sizes of files and miss the rows that `explode` adds, so it would broadcast tables that no driver holds."""
    return df.hint("merge")


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if it has at most BROADCAST_ROWS rows; else joins shuffle it."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else shuffled(df)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... in the given order, without moving all rows to one task.

    Rows are range-partitioned and sorted; each partition's first number is the sum of the counts before it."""
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    rows = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    out = rows.join(F.broadcast(bases), "_part")  # a row for each partition
    return out.select(*df.columns, (F.col("_base") + F.col("_at")).cast("long").alias(name))
