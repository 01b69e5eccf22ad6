"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised. A table hashes each by the whole parts of (a.v + b) / width for PROJECTIONS
Gaussian directions a and offsets b; vectors with equal whole parts share a bucket. Vectors of one bucket
are compared exactly, in double precision, as blocks of a matrix product. A pair that shares buckets in
several tables counts in the first only, which both rows' bucket lists show, so links are counted where
they are found: a task sends a sum for each vector and a spanning forest, never all pairs.

Equal vectors are one member with a count. Buckets without company are dropped before vectors move.
Buckets of more than `block` members are cut into tiles, and each pair of tiles is compared in a task of its
own, so no task holds an unbounded bucket and no pair in it is lost.

The default tables find a pair at cosine 0.95 with probability 0.96 and nearer pairs almost surely; found
links are exact.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing: n_links 0, component_id their own vec_id. Vectors link only with those of their length. Rows of one
vec_id and equal vectors are separate rows of one class, and link. An empty table gives an empty result.
Other columns, labels too, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import materialise, prepare
from streetweave.llm.components import connected_components, smallest_member

TABLES, PROJECTIONS, WIDTH, SEED = 48, 20, 2.0, 42
#: Members of a bucket compared in one task.
BLOCK = 2048


def _directions(dims: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dims])
    return rng.standard_normal((dims, tables * projections)), rng.uniform(0, width, tables * projections)


def buckets(vectors: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """The bucket of each normalised vector in each table: the hash of its whole parts."""
    a, b = _directions(vectors.shape[1], tables, projections, width)
    parts = np.floor((vectors @ a + b) / width).astype("<i2").reshape(len(vectors), tables, projections)
    head = vectors.shape[1].to_bytes(4, "little")
    return np.array([[xxhash.xxh64_intdigest(head + row.tobytes(), t) for t, row in enumerate(rows)] for rows in parts], dtype=np.uint64).view(np.int64).reshape(len(vectors), tables)


def _hashed(members: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """members (node, n, v) -> node, n, v (normalised), keys."""
    prepare(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for dims in sorted({len(x) for x in lists}):
                at = [i for i, x in enumerate(lists) if len(x) == dims]
                v = np.array([lists[i] for i in at], dtype=np.float64)
                v /= np.abs(v).max(axis=1)[:, None]  # no overflow of squares
                v /= np.sqrt((v * v).sum(axis=1))[:, None]
                keys = buckets(v, tables, projections, width)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "n", "v", "keys"])

    return members.select("node", "n", "v").mapInArrow(run, "node long, n long, v binary, keys array<long>")


def _compare(cells: DataFrame, cosine: float) -> DataFrame:
    """cells (cell, tile, table, node, n, v, keys; a cell's rows together) -> (a, b, links): for b = -1 what to add to a's links, else a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            ids = _numbered(table)
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield from _within(table.slice(0, cut), ids[:cut], cosine)
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from _within(table, _numbered(table), cosine)

    return cells.mapInArrow(run, "a long, b long, links long")


def _numbered(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    for name in ("table", "key", "x", "y"):
        c = table.column(name).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _within(table: pa.Table, ids: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    node, n, number, tile, x, y = (table.column(c).to_numpy() for c in ("node", "n", "table", "tile", "x", "y"))
    vectors = table.column("v").to_pylist()
    keys = np.array(table.column("keys").to_pylist(), dtype=np.int64)
    sums: dict[int, int] = {}
    links: list[tuple[int, int]] = []
    bounds = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids)).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi - lo < 2:
            continue
        first = int(number[lo])
        v = np.frombuffer(b"".join(vectors[lo:hi]), dtype=np.float64).reshape(hi - lo, -1)
        # Rows of the cell's first tile against those of the second, or a tile against itself.
        left, right = lo + np.flatnonzero(tile[lo:hi] == x[lo]), lo + np.flatnonzero(tile[lo:hi] == y[lo])
        parent: dict[int, int] = {}

        def find(p: int) -> int:
            while (q := parent.get(p, p)) != p:  # noqa: B023
                parent[p] = parent.get(q, q)  # noqa: B023
                p = q
            return p

        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(v[rows - lo] @ v[right - lo].T >= cosine)
            i, j = rows[i], right[j]
            keep = i < j if x[lo] == y[lo] else i != j
            i, j = i[keep], j[keep]
            if first and len(i):
                fresh = np.concatenate([~(keys[i[s : s + 20_000], :first] == keys[j[s : s + 20_000], :first]).any(axis=1) for s in range(0, len(i), 20_000)])
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            add = np.bincount(i - lo, weights=n[j], minlength=hi - lo) + np.bincount(j - lo, weights=n[i], minlength=hi - lo)
            for k in np.flatnonzero(add).tolist():
                sums[int(node[lo + k])] = sums.get(int(node[lo + k]), 0) + int(add[k])
            for p, q in zip(node[i].tolist(), node[j].tolist(), strict=True):
                rp, rq = find(p), find(q)
                if rp != rq:
                    parent[rp] = rq
                    links.append((p, q))
    a = list(sums) + [p for p, _ in links]
    b = [-1] * len(sums) + [q for _, q in links]
    c = list(sums.values()) + [0] * len(links)
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (a, b, c)], names=["a", "b", "links"])


def near_dup_vectors(rows: DataFrame, cosine: float = 0.95, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    prepare(spark)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)))
    # Members are numbered by the hash of their id and vector, which also serves rows without or with equal ids.
    members = materialise(good.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("id")).withColumn("node", F.xxhash64("id", "v").bitwiseAND(F.lit((1 << 63) - 1))), "vectors")
    hashed = materialise(_hashed(members, tables, projections, width), "vectors-hashed")
    probes = hashed.select("node", F.posexplode("keys").alias("table", "key"))
    sizes = probes.groupBy("table", "key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = materialise(probes.join(sizes, ["table", "key"]).withColumn("tiles", F.ceil(F.col("size") / block).cast("int")), "vectors-shared")
    tile = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    cells = shared.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))
    cells = cells.drop("size", "tiles", "other").join(hashed.withColumnRenamed("node", "its_node"), F.col("node") == F.col("its_node"))
    cells = cells.select("table", "key", "x", "y", "tile", "node", "n", "v", "keys")
    cells = cells.repartition("table", "key", "x", "y").sortWithinPartitions("table", "key", "x", "y")
    found = materialise(_compare(cells, cosine), "vectors-links")
    links = found.where("b = -1").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("l_node"), "links")
    roots = connected_components(found.where("b <> -1").select("a", "b"))
    groups = smallest_member(members.select("node", "id"), roots).select(F.col("node").alias("g_node"), "smallest")
    by_vector = members.select(F.col("v").alias("m_v"), "node", F.col("n").alias("copies"))
    by_vector = by_vector.join(links, F.col("node") == F.col("l_node"), "left").join(groups, F.col("node") == F.col("g_node"))
    out = good.join(by_vector, F.col("v") == F.col("m_v"))
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("smallest").alias("component_id"))
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
