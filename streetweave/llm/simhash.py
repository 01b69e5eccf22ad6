"""SimHash near-dedup: fingerprints of word shingles, joined by a binary trie of their bits.

A fingerprint bit is 1 if it is set in over half the hashes of a text's shingles. Two fingerprints link
when they differ in at most `budget` bits. They are found by walking a binary trie against itself: a
pair of nodes carries the differing bits of its two prefixes, goes on to the pairs of their children,
and is dropped once the bits exceed the budget; pairs of nodes with few fingerprints end with bit counts,
all against all.

The walk is shared out in two ways. A pair within the budget agrees in one of budget + 1 stretches of
bits, so the trie is built once for each stretch, turned to the front, and the walk starts at the pairs
of equal prefixes of that length. Node pairs with more than `crowd` fingerprints are divided further by
their next bits, again and again, with the bits that differ counted on; so no task holds an unbounded
group, and none is capped. Equal fingerprints are one member. Found links leave a task as a spanning
forest, never as all pairs, and components are found by contraction on all executors.

Defined results: a text without words (null, empty, blank) has fingerprint zero, linked like any other.
Rows of one fingerprint are always together. An empty table gives an empty result. Other columns are not
read but for those that `keep_one` passes through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import materialise, prepare
from streetweave.llm.components import connected_components, smallest_member

#: Fingerprints in a node pair above which it is divided.
CROWD = 8192
#: The same for whole fingerprints in bands, of which each division makes more copies.
BAND_CROWD = 1 << 17
#: Node pairs walked at once, rows of whole node pairs held at once, and rounds of first links.
FRONT, HELD, ROUNDS = 1 << 18, 1 << 15, 3
#: Rows of a trie node up to which node pairs aren't followed further, but compared row by row.
SIDE = 32
#: Bits by which it is then divided.
STEP = 6
_CHUNK = 1 << 16
_MASK = (1 << 64) - 1
_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of `words` words, A-Z lower-cased, in blocks; the whole sequence if there are fewer."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    if len(tokens) <= words:
        yield np.array([_xxh(b" ".join(tokens))], dtype=np.uint64)
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    for at in range(0, len(starts), _CHUNK):
        parts = map(joined.__getitem__, map(slice, starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()))
        n = min(_CHUNK, len(starts) - at)
        yield np.fromiter(map(_xxh, parts), dtype=np.uint64, count=n)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash: a finaliser of shifts and odd multipliers."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & _MASK)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, words: int, bits: int = 64) -> np.ndarray:
    """bits / 64 unsigned integers, the most significant bits first; the first are those of XXH64 itself."""
    k = bits // 64
    sums, n = np.zeros(bits, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        for j in range(k):
            raw = (_mix(h, j) if j else h).astype(">u8").view(np.uint8).reshape(-1, 8)
            sums[64 * j : 64 * j + 64] += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n).view(">u8").astype(np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes of a text, rising."""
    blocks = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, dtype=np.uint64)


def set_fingerprint(shingles: np.ndarray, bits: int) -> bytes:
    """`bits` / 8 bytes, most significant first: each different shingle counts once, as in the Jaccard similarity."""
    sums = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        h = shingles[at : at + _CHUNK]
        for j in range(bits // 64):
            raw = (_mix(h, j) if j else h).astype(">u8").view(np.uint8).reshape(-1, 8)
            sums[64 * j : 64 * j + 64] += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > len(shingles)).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sets(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, key: the set's fingerprint and 16 bytes of a digest of the whole set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                keys.append(set_fingerprint(s, bits) + xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["doc_id", "text", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, key binary")


def fingerprints(docs: DataFrame, words: int = 5, bits: int = 64) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp: `bits` / 8 bytes, most significant first."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, bits).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def _ranges(ones: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the children of trie nodes [lo, hi) part: rows with bit 0 come first."""
    return hi - (ones[hi] - ones[lo])


class Groups:
    """Rows that links have connected, and the links that did it."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []
        self.runs: np.ndarray | None = None

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        _, first = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for k in np.sort(first).tolist():
            ra, rb = find(int(a[k])), find(int(b[k]))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                self.links.append((int(i[k]), int(j[k])))
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = find(x)
        self.label, self.runs = to[self.label], None

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The label that all rows of [lo, hi) have, or -1."""
        if self.runs is None:
            self.runs = np.cumsum(np.diff(self.label, prepend=self.label[:1]) != 0)
        return np.where(self.runs[lo] == self.runs[hi - 1], self.label[lo], -1)

    def apart(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether rows of [lo, hi) and [lo2, hi2) may still be unconnected."""
        one = self.whole(lo, hi)
        return (one < 0) | (one != self.whole(lo2, hi2))


def walk(keys: np.ndarray, depth: int, width: int, budget: int, pairs: tuple[np.ndarray, ...], close, groups: Groups) -> None:
    """Traverse node pairs of a trie over `keys`, `width` bits at the top of each uint64.

    pairs: (lo, hi, lo2, hi2, differing bits) of node pairs at `depth`, as ranges of rows that are sorted within
    each; the ranges of a pair are equal or disjoint. Of keys within the budget, those that close(i, j) lists, in that order, are
    linked in `groups`; node pairs whose rows are already connected aren't followed. Memory is bounded: long fronts are
    walked in slices."""
    bits: dict[int, np.ndarray] = {}

    def ones(d: int) -> np.ndarray:
        if d not in bits:
            bits[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d) & np.uint64(1)).astype(np.int64))])
        return bits[d]

    stack = [(depth, tuple(np.asarray(x, dtype=np.int64) for x in pairs))]
    while stack:
        depth, (lo, hi, lo2, hi2, err) = stack.pop()
        if len(lo) > FRONT:
            for at in range(0, len(lo), FRONT // 2):
                stack.append((depth, tuple(x[at : at + FRONT // 2] for x in (lo, hi, lo2, hi2, err))))
            continue
        same = lo == lo2
        alive = (hi > lo) & (hi2 > lo2) & (err <= budget) & ~(same & (hi - lo == 1))
        lo, hi, lo2, hi2, err, same = (x[alive] for x in (lo, hi, lo2, hi2, err, same))
        if not len(lo):
            continue
        alive = groups.apart(lo, hi, lo2, hi2)
        # Few rows are sooner compared than parted: near the leaves there are more node pairs than near rows.
        small = (hi - lo <= SIDE) & (hi2 - lo2 <= SIDE)
        for i, j in _compared(keys, *(x[small & alive] for x in (lo, hi, lo2, hi2)), budget, groups):
            near = np.flatnonzero(groups.label[i] != groups.label[j])
            near = near[close(i[near], j[near])]
            groups.add(i[near], j[near])
        leaf = ~small if depth >= width else np.zeros(len(lo), dtype=bool)
        for i, j in _expand(*(x[leaf & alive] for x in (lo, hi, lo2, hi2))):
            near = np.flatnonzero((np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (groups.label[i] != groups.label[j]))
            near = near[close(i[near], j[near])]
            groups.add(i[near], j[near])
        lo, hi, lo2, hi2, err, same = (x[alive & ~small & ~leaf] for x in (lo, hi, lo2, hi2, err, same))
        if depth >= width or not len(lo):
            continue
        n = ones(depth)
        m, m2 = hi - (n[hi] - n[lo]), hi2 - (n[hi2] - n[lo2])  # rows with bit 0 come first
        other = ~same
        both = ((lo, m, lo, m[other]), (m, hi, m, hi[other]), (lo2, m2, m2, lo2[other]), (m2, hi2, hi2, m2[other]), (err, err, err + 1, err[other] + 1))
        stack.append((depth + 1, tuple(np.concatenate(x) for x in both)))


def _compared(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int, groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the ranges' rows whose keys are within the budget, each once, from blocks of ranges of about one length.

    Ranges that `groups` has connected by the time of their block are left out."""
    order = np.argsort(-np.maximum(hi - lo, hi2 - lo2), kind="stable")
    pairs = tuple(x[order] for x in (lo, hi, lo2, hi2))
    at = 0
    while at < len(lo):
        first, last, first2, last2 = (x[at] for x in pairs)
        block = slice(at, at + max(1, FRONT // int(max(last - first, last2 - first2)) ** 2))
        at = block.stop
        some = tuple(x[block] for x in pairs)
        s, e, s2, e2 = (x[groups.apart(*some)] for x in some)
        if not len(s):
            continue
        a, b = int((e - s).max()), int((e2 - s2).max())
        # Shorter ranges are filled up with rows behind them, whose pairs are left out.
        i = np.minimum(s[:, None] + np.arange(a), len(keys) - 1)
        j = np.minimum(s2[:, None] + np.arange(b), len(keys) - 1)
        near = np.flatnonzero(np.bitwise_count(keys[i][:, :, None] ^ keys[j][:, None, :]) <= budget)
        row, c = np.divmod(near, b)
        pair, r = np.divmod(row, a)
        i, j = s[pair] + r, s2[pair] + c
        # Of a node with itself both orders are there.
        own = (i < e[pair]) & (j < e2[pair]) & (i < j)
        yield i[own], j[own]


def _expand(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the ranges' rows, in blocks."""
    n = (hi - lo) * (hi2 - lo2)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    for at in range(0, total, FRONT):
        flat = np.arange(at, min(total, at + FRONT))
        c = np.searchsorted(ends, flat, side="right")
        k = flat - (ends[c] - n[c])
        i, j = lo[c] + k // (hi2 - lo2)[c], lo2[c] + k % (hi2 - lo2)[c]
        yield i[i != j], j[i != j]


def _turned(key: str, width: int, at: int) -> F.Column:
    """The `width` bits at the top of a long, turned left by `at`, zero below."""
    k = F.col(key)
    if at == 0:
        return k
    keep = ((1 << width) - 1) << (64 - width)
    keep = keep - (1 << 64) if keep >> 63 else keep
    return F.shiftleft(k, at).bitwiseOR(F.shiftrightunsigned(k, width - at)).bitwiseAND(F.lit(keep))


def trie_links(keys: DataFrame, width: int, budget: int, most: int | None = None, crowd: int = CROWD, every: bool = False) -> DataFrame:
    """keys (node, band, key, payload) -> (a, b): spanning links of nodes whose keys of one band differ in at most `budget` bits.

    key: a long with `width` bits at the top. payload: None, or a whole fingerprint; with `most`, linked ones differ in at most so
    many bits, and the nearest link first. every: `keys` have a label besides, payloads begin with the bands, and all pairs of
    different labels come out, once each.
    A node has one key a band; equal keys link like others."""
    spark = keys.sparkSession
    prepare(spark)
    label = F.col("label") if every else F.lit(None).cast("long").alias("label")
    stretch = width // (budget + 1)
    turns = [F.struct(F.lit(t).alias("turn"), _turned("key", width, t * stretch).alias("k")) for t in range(budget + 1)]
    rows = keys.select("node", "band", "payload", label, F.explode(F.array(*turns)).alias("t")).select("node", "payload", "label", (F.col("band") * (budget + 1) + F.col("t.turn")).alias("trie"), F.col("t.k").alias("k"))
    prefix = F.shiftrightunsigned("k", 64 - stretch)
    rows = rows.select("node", "payload", "label", "trie", "k", F.lit(stretch).alias("depth"), prefix.alias("own"), prefix.alias("other"))
    cell = ["trie", "depth", "x", "y"]
    done: DataFrame | None = None
    while True:
        rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        # A pair of different nodes needs rows on both sides.
        crowded = sizes.where((F.col("n") > crowd) & (F.col("depth") < width) & (F.col("lo") == F.col("x")) & (F.col("hi") == F.col("y")))
        crowded = materialise(crowded.select(*cell), "trie-crowded")
        some = not crowded.isEmpty()
        part = (rows.join(crowded, cell, "left_anti") if some else rows).select(*cell, "own", "k", "node", "payload", "label")
        done = part if done is None else done.unionByName(part)
        if not some:
            break
        big = rows.join(crowded, cell, "left_semi")
        step = F.least(F.lit(STEP), F.lit(width) - F.col("depth"))
        down = F.expr(f"shiftrightunsigned(k, 64 - depth - least({STEP}, {width} - depth))")
        big = big.withColumn("step", step).withColumn("down", down)
        masks = F.array(*[F.lit(m) for m in range(1 << STEP) if bin(m).count("1") <= budget])
        big = big.withColumn("mask", F.explode(masks))
        low = F.expr("shiftleft(1L, step) - 1")
        big = big.where((F.col("mask") <= low) & (F.bit_count(F.col("mask")) + F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget))
        other = F.expr("shiftleft(other, step)").bitwiseOR(F.col("down").bitwiseAND(low).bitwiseXOR(F.col("mask").cast("long")))
        rows = materialise(big.select("node", "payload", "label", "trie", "k", (F.col("depth") + F.col("step")).cast("int").alias("depth"), F.col("down").alias("own"), other.alias("other")), "trie-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            # Whole node pairs only: the rows of the last one wait for the next batch.
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                table = pa.Table.from_batches(held)
                ids = _cells(table)
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield from _links(table.slice(0, cut), ids[:cut], width, budget, most, every)
                held = table.slice(cut).combine_chunks().to_batches()
                n = min(table.num_rows - cut, HELD // 2)
        if held:
            table = pa.Table.from_batches(held)
            yield from _links(table, _cells(table), width, budget, most, every)

    return done.repartition(*cell).sortWithinPartitions(*cell, "own", F.col("k").bitwiseXOR(F.lit(-(1 << 63)))).mapInArrow(run, "a long, b long")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _cells(table: pa.Table) -> np.ndarray:
    """The number of each row's node pair, rising."""
    new = np.zeros(table.num_rows, dtype=bool)
    for name in ("trie", "depth", "x", "y"):
        c = _column(table, name)
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _first_trie(payload: np.ndarray, i: np.ndarray, j: np.ndarray, width: int, budget: int) -> np.ndarray:
    """The first of the tries in which pairs meet, from payloads that begin with the bands: a pair comes out there only."""
    bands = np.ascontiguousarray(payload[:, : BITS // 64]).view(np.uint8).reshape(len(payload), -1, width // 8)
    differ = bands[i] ^ bands[j]
    band = (np.bitwise_count(differ).sum(axis=2) <= budget).argmax(axis=1)
    bits = np.unpackbits(differ[np.arange(len(i)), band], axis=1)
    stretch = width // (budget + 1)
    turn = (~bits[:, : stretch * (budget + 1)].reshape(len(i), budget + 1, stretch).any(axis=2)).argmax(axis=1)
    return band * (budget + 1) + turn


def _links(table: pa.Table, ids: np.ndarray, width: int, budget: int, most: int | None, every: bool) -> Iterator[pa.RecordBatch]:
    keys = _column(table, "k").view(np.uint64)
    own, x, y, depth, node, trie = (_column(table, c) for c in ("own", "x", "y", "depth", "node", "trie"))
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    ends = np.append(starts[1:], len(ids))
    # Rows of a pair are sorted by their own node: those of x, then those of y.
    in_x = np.concatenate([[0], np.cumsum(own == x)])
    split = starts + in_x[ends] - in_x[starts]
    self_pair = x[starts] == y[starts]
    err = np.bitwise_count((x[starts] ^ y[starts]).view(np.uint64)).astype(np.int64)
    lo2, hi = np.where(self_pair, starts, split), np.where(self_pair, ends, split)
    payload = None
    if most is not None:
        payload = np.frombuffer(b"".join(table.column("payload").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if payload is None:
            return np.arange(len(i))
        differ = np.bitwise_count(payload[i] ^ payload[j]).sum(axis=1, dtype=np.int64)
        near = np.argsort(differ, kind="stable")[: int((differ <= most).sum())]
        if not every:
            return near
        found = _first_trie(payload, i[near], j[near], width, budget) == trie[i[near]]
        pairs.append(np.sort(node[np.stack([i[near], j[near]])[:, found]], axis=0))
        return near[:0]

    pairs: list[np.ndarray] = []
    groups = Groups(table.num_rows)
    if every:
        _, first_of, at_label = np.unique(_column(table, "label"), return_index=True, return_inverse=True)
        groups.label = first_of[at_label]
    # Nodes of copies are full of links; a few rows compared with all of their node connect most of it.
    first, span = starts[self_pair], (ends - starts)[self_pair]
    for _ in range(0 if every else ROUNDS):
        loose = np.bincount(groups.label, minlength=len(ids))[groups.label] == 1
        pivots = np.array([s + int(np.argmax(loose[s : s + n])) for s, n in zip(first[span > 2].tolist(), span[span > 2].tolist(), strict=True)], dtype=np.int64)
        n = span[span > 2]
        i = np.repeat(pivots, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[span > 2], n)
        near = np.flatnonzero((i != j) & (groups.label[i] != groups.label[j]) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget))
        near = near[close(i[near], j[near])]
        groups.add(i[near], j[near])
    for d in np.unique(depth[starts]):
        at = np.flatnonzero(depth[starts] == d)
        walk(keys, int(d), width, budget, (starts[at], hi[at], lo2[at], ends[at], err[at]), close, groups)
    links = np.concatenate([np.zeros((2, 0), dtype=np.int64), *pairs] if every else [node[np.array(groups.links, dtype=np.int64).reshape(-1, 2).T]], axis=1)
    if links.size:
        a, b = np.unique(np.sort(links, axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_dup_64(docs: DataFrame, words: int = 3, budget: int = 2, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hexadecimal digits), component_id.

    The fingerprint has 64 bits; those within `budget` differing bits link; component_id is the smallest doc_id that links reach."""
    fps = materialise(fingerprints(docs, words, 64).select("doc_id", F.expr("cast(conv(hex(fp), 16, -10) as bigint)").alias("node")), "simhash")
    members = materialise(fps.groupBy("node").agg(F.min("doc_id").alias("id")), "simhash-members")
    keys = members.select("node", F.lit(0).alias("band"), F.col("node").alias("key"), F.lit(None).cast("binary").alias("payload"))
    roots = connected_components(trie_links(keys, 64, budget, crowd=crowd))
    groups = smallest_member(members, roots).select(F.col("node").alias("its_node"), "smallest")
    out = fps.join(groups, F.col("node") == F.col("its_node"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("smallest").alias("component_id"))


#: For word shingles of a similarity: bits of a fingerprint, of a band, and differing bits allowed in a band.
BITS, BAND, BAND_BUDGET = 256, 32, 4
#: Bits of the fingerprints by which the second walk lists pairs, of the few groups that are left open.
WIDE = 2048
#: Standard deviations of the differing bits above the mean, where pairs end.
MOST = 3.0


def differing_bits(similarity: float, bits: int) -> int:
    """Differing bits that sets of that (Jaccard) similarity hardly ever exceed.

    The mean is the angle between sets of shingles of one size, as a share of the half turn."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + MOST * (bits * p * (1 - p)) ** 0.5)


def _wide(texts: DataFrame, words: int) -> DataFrame:
    """texts (node, text, label) -> node, label, payload: the set's fingerprint of WIDE bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [set_fingerprint(shingle_set(t.as_py(), words), WIDE) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide, pa.binary())], names=["node", "label", "payload"])

    return texts.select("node", "label", "text").mapInArrow(run, "node long, label long, payload binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of `texts` (node, text) whose shingle sets have the similarity."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # Rows come by b.
                if last[1] is None or last[0] != b:
                    last = b, shingle_set(b, words)
                near.append(jaccard(shingle_set(a, words), last[1]) >= similarity)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_dup(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = BAND_CROWD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, component_id, for texts whose sets of shingles have a Jaccard similarity.

    Fingerprints of BITS bits are cut into bands of BAND bits. The trie finds fingerprints that differ in at most
    BAND_BUDGET bits of a band, and in no more bits in all than the similarity allows. Links that span these pairs, the nearest
    first, are confirmed by the sets' similarity itself. Where one isn't, and its ends stay apart, a second walk lists all pairs between
    the groups so left open, within the similarity by fingerprints of WIDE bits, and these are confirmed in turn: no found pair is lost, and a group of copies never comes out as all its
    pairs. Texts of one set are one member, and members of one smallest id are linked; component_id is null where all ids are."""
    sets = materialise(_sets(docs, words, BITS), "simhash")
    members = sets.groupBy("key").agg(F.min("doc_id").alias("id")).select("key", F.xxhash64("key").alias("node"), "id")
    members = materialise(members, "simhash-members")
    bands = [F.struct(F.lit(j).alias("band"), F.expr(f"shiftleft(cast(conv(substr(hex(key), {BAND // 4 * j + 1}, {BAND // 4}), 16, 10) as bigint), {64 - BAND})").alias("k")) for j in range(BITS // BAND)]
    keys = members.select("node", F.expr(f"substr(key, 1, {BITS // 8})").alias("payload"), F.explode(F.array(*bands)).alias("s")).select("node", F.col("s.band").alias("band"), F.col("s.k").alias("key"), "payload")
    most = differing_bits(similarity, BITS)
    pairs = materialise(trie_links(keys, BAND, BAND_BUDGET, most, crowd).distinct(), "simhash-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = members.join(wanted, "node", "left_semi").select(F.col("key").alias("its_key"), "node")
    # One text stands for all of a set.
    texts = materialise(sets.join(wanted, F.col("key") == F.col("its_key")).groupBy("node").agg(F.first("text").alias("text")), "simhash-texts")
    same = members.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("id IS NOT NULL AND n > 1").select(F.col("id").alias("its_id"), "a")
    same = members.join(same, F.col("id") == F.col("its_id")).select("a", F.col("node").alias("b"))
    links = materialise(_confirmed(pairs, texts, words, similarity).union(same), "simhash-links")
    roots = materialise(connected_components(links), "simhash-roots")
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")).where("a_root <> b_root")
    open_ = materialise(apart.select(F.col("a_root").alias("label")).union(apart.select("b_root")).distinct(), "simhash-open")
    if not open_.isEmpty():
        labels = members.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")).join(open_, "label", "left_semi")
        wide = materialise(_wide(texts.join(labels, "node"), words), "simhash-wide")
        more = trie_links(keys.drop("payload").join(wide, "node"), BAND, BAND_BUDGET, differing_bits(similarity, WIDE), crowd, every=True)
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "simhash-more")
        links = links.union(_confirmed(more, texts, words, similarity))
        roots = connected_components(links)
    groups = smallest_member(members.select("node", "id"), roots).select(F.col("node").alias("its_node"), "smallest")
    groups = members.select("key", "node").join(groups, F.col("node") == F.col("its_node")).select(F.col("key").alias("its_key"), "smallest")
    return sets.select("doc_id", "key").join(groups, F.col("key") == F.col("its_key")).select("doc_id", F.col("smallest").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` (doc_id, text, any other columns) whose id is the smallest of its group.

    Rows of one id are one document, kept or dropped together; rows of a null id stay, as nothing names them."""
    groups = near_dup(docs, words, similarity)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("its_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["its_doc"], "left_anti")
