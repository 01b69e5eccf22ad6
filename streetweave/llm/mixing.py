"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is wanted target / source size times. The whole part of that is taken as
certain copies. What is left of the target is drawn among the source's documents, with inclusion
probabilities p in proportion to their sizes (rounded down to their six leading bits); where that exceeds 1, the
document's further copy is certain as well. Documents larger than what is left are not drawn if the others suffice.
Documents are ranked by the odds of a fixed random number u over the
odds of p, and the lowest ranks are taken until their sizes come nearest to what is left. So long documents, by
which the sum would overshoot, are mostly decided first, and a source's words end within half a document of
its target.

The random number comes from the MD5 of the seed and the document's id, so reruns, other partition
counts and lost executors give the same mix. The cut is found on histograms of the rank, summed before
the shuffle, each of which divides the bin of the one before; only a bin of few documents is sorted. Sources
are numbered by range partitions, and the level of the targets is found by sums over all sources in rounds, so
they may be many.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of
size 0 are taken as whole copies only. Null ids draw by the MD5 of their text. Rows with one id and size tie: they
are taken or left together, which for many such rows may end further from the target. An empty table gives an
empty result. Other columns are not read by `plan_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetweave.llm.common import materialise
from streetweave.runtime import number_rows

WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of a rank, and those that a histogram tells apart; rows of a bin that one task sorts.
RANK_BITS, BIN_BITS, EDGE_ROWS = 48, 12, 200_000
#: Leading bits of a size that count in its inclusion probability, so that a source has a bounded number of sizes.
LEADING = 6
#: Sources, of some 100 bytes each, up to which their table is broadcast; beyond, it is joined by a shuffle.
FEW_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target.

    The targets share the sum of all sizes by weight and stop at `most` times their source's size. The level (share of one unit
    of weight) is what the sources that don't stop can still take over their weights; it rises as sources stop, in rounds."""
    t = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    t = materialise(t.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-weights")
    level, stopped = 0.0, -1
    while True:
        stops = F.col("cap") <= F.col("weight") * F.lit(level)
        n = t.agg(F.count(F.when(stops, 1)).alias("stopped"), F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0.0)).alias("held"), F.sum(F.when(~stops, F.col("weight"))).alias("open")).first()
        if n["stopped"] == stopped or n["open"] is None:
            break
        stopped, level = n["stopped"], (float(n["all"]) - n["held"]) / n["open"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level) if n["open"] is not None else F.col("cap")).alias("target"))


def _uniform(seed: int) -> F.Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def _leading(size: F.Column) -> F.Column:
    """A size with all but its first LEADING bits zero."""
    drop = F.greatest(F.length(F.bin(size)) - LEADING, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def _inclusion(slim: DataFrame, t: DataFrame) -> DataFrame:
    """source, lam, x_open: documents of a rounded size above x_open have p = 1, others lam times that size."""
    sizes = _at(slim.where("size > 0"), t.where("rest > 0").select("source", "rest", "largest")).where("size <= largest")
    sizes = sizes.groupBy("source", "x", "rest").agg(F.sum("size").cast("double").alias("part"))
    larger = Window.partitionBy("source").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lam = (F.col("rest") - F.coalesce(F.sum("part").over(larger), F.lit(0.0))) / F.sum(F.col("x") * F.col("part")).over(smaller)
    sizes = sizes.withColumn("lam", lam).where(F.col("lam") * F.col("x") <= 1)
    return sizes.groupBy("source").agg(F.max(F.struct("x", "lam")).alias("c")).select("source", F.col("c.lam").alias("lam"), F.col("c.x").alias("x_open"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds v, the random odds over the inclusion odds as a share of itself and 1, and place, its RANK_BITS leading bits."""
    p = F.when(F.col("x") > F.col("x_open"), F.lit(1.0)).otherwise(F.col("lam") * F.col("x"))
    rows = rows.withColumn("p", p)
    against = F.col("u") * (1 - F.col("p"))
    rows = rows.withColumn("v", F.when((F.col("size") > 0) & (F.col("rest") > 0) & (F.col("size") <= F.col("largest")), against / (against + (1 - F.col("u")) * F.col("p"))))
    return rows.withColumn("place", F.least(F.floor(F.col("v") * float(1 << RANK_BITS)).cast("long"), F.lit((1 << RANK_BITS) - 1)))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source, source_size, target, copies, taken."""
    return _plan(docs, weights, most, seed, ())


def _plan(docs: DataFrame, weights: Sequence[float], most: float, seed: int, keep: Sequence[str]) -> DataFrame:
    """The plan, and the columns of `keep` as keep_..."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col("doc_id"), F.col("source"), size.alias("size"), _uniform(seed).alias("u")]
    # Every later pass but the last reads this, not the texts.
    slim = materialise(docs.select(*own).withColumn("x", _leading(F.col("size"))), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, weights, most).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    t = t.withColumn("whole", F.floor("ratio")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    t = _small(t)
    fits = _at(slim, t.select("source", "rest")).groupBy("source").agg(F.sum(F.when(F.col("size") <= F.col("rest"), F.col("size"))).alias("fits"))
    t = _at(t, fits).withColumn("largest", F.when(F.col("fits") >= F.col("rest"), F.col("rest")).otherwise(F.lit(float("inf")))).drop("fits")
    t = _small(_at(t, _inclusion(slim, t), "left"))

    # Each round divides the bin in which the cut falls, until it is small enough to be sorted.
    cut, shift = t.select("source", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("below")), RANK_BITS
    while True:
        at_bin = F.shiftright("place", shift) == F.col("bin")
        shift -= BIN_BITS
        part = _at(_ranked(_at(slim, t)), cut).where(at_bin)
        bins = part.groupBy("source", "rest", "below", F.shiftright("place", shift).alias("slot")).agg(F.sum("size").alias("bin_size"), F.count("*").alias("n"))
        w = Window.partitionBy("source").orderBy("slot")
        bins = bins.withColumn("before", F.col("below") + F.sum("bin_size").over(w) - F.col("bin_size"))
        bins = bins.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest")))
        cut = _small(bins.groupBy("source").agg(F.min(F.struct("slot", "before", "n")).alias("c")).select("source", F.col("c.slot").alias("bin"), F.col("c.before").alias("below"), F.col("c.n").alias("n")))
        if shift == 0 or (cut.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
        cut = cut.drop("n")
    edge = _at(_ranked(_at(slim, t)), cut).where(F.shiftright("place", shift) == F.col("bin"))
    run = Window.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("before", F.col("below") + F.sum("size").over(run) - F.col("size"))
    edge = edge.where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max("v").alias("edge_v"))
    by_source = _small(_at(_at(t, cut.select("source", "bin"), "left"), edge, "left"))
    out = docs.select(*own, *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep]).withColumn("x", _leading(F.col("size"))) if keep else slim
    out = _ranked(_at(out, by_source))
    slot = F.shiftright("place", shift)
    extra = F.coalesce((slot < F.col("bin")) | ((slot == F.col("bin")) & (F.col("v") <= F.coalesce("edge_v", F.lit(-1.0)))), F.lit(False))
    copies = F.col("whole") + F.when(extra, F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"keep_{c}") for c in keep])


def _at(left: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null with null."""
    return left.join(by_source.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")), how).drop("its_source")


def _small(by_source: DataFrame) -> DataFrame:
    """A table with a row for each source: computed once, and broadcast where it has FEW_SOURCES rows at most."""
    kept = materialise(by_source, "mix-sources")
    return F.broadcast(kept) if kept.count() <= FEW_SOURCES else kept


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """The mix itself: every document as often as `plan_mix` takes it, with the columns of `docs`."""
    out = _plan(docs, weights, most, seed, docs.columns).where(F.col("copies") > 0)
    out = out.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy"), *[F.col(f"keep_{c}") for c in docs.columns])
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])
