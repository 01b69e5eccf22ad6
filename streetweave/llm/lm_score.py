"""Language-model scores of texts by a weighted backoff automaton of smoothed n-grams.

States are contexts (the last words read), arcs are the n-grams seen in training, and every state has a
failure arc to the state of the shorter context, down to the state without context, which has an arc for
every word. With c the training counts, m the weight of the prior of an order, and h' the context h
without its first word,

    p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m)        p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

so a seen arc weighs log10 of the whole, and the failure arc of h weighs log10(m / (c(h) + m)). A text is
read once, from left to right: the state is carried along, and an arc, or failure arcs and the arc behind
them, add their weights. Contexts reach back to the text's start, which counts as one word.

No model is held in one place. Documents are taken in blocks of a bounded size. A block's distinct n-grams,
as sorted hashes with counts, are cut into FAN ranges; of each range the runs of at most some FAN blocks are added
up to one run, which is cut into FAN ranges in turn, until a range has one run: a tree of sums. Totals go
back down the tree, so that each block gets those of its own n-grams: the part of the automaton that it can
walk. Rows sent are FAN a block, an order and a level, and levels grow with the logarithm of the corpus; an
n-gram of all blocks is added up on the way, and no task holds more than FAN runs. Every n-gram of every training
text counts, at any size of the corpus. From order three on, n-grams stay at home if one of their two
shorter n-grams occurs in this block alone, since they then do as well.

Words are told apart by 64-bit hashes, n-grams by hashes of these. With g different n-grams the chance that
any two share a hash is g * g / 2 ** 65; two that do would share their counts.

Defined results: a null text is the empty text, which has the end token alone. Null ids are not learned
from unless `trains` is true for them. With nothing to learn from, every word is unknown. Rows of one id are
separate texts. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import materialise, prepare

#: Bytes of text in a block, about; ways of the tree of sums, a power of two; tokens whose arcs are laid out at once.
BLOCK, FAN, SLICE = 4 << 20, 256, 50_000
#: The weight of the prior of each order from the second on; the automaton has one order more than weights.
PRIORS = (500.0, 5.0)
ADD = 0.1
END, START = b" ", b"  "  # no word contains white space


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    return [*(text or "").encode().lower().split(), END]


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, trains) -> blocks of documents as word numbers, with the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words: dict[bytes, int] = {START: 0}
        ids: list = []
        trains: list[bool] = []
        parts: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            columns = [
                pa.array([part << 32 | number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([trains], pa.list_(pa.bool_())),
                pa.array([int(lengths[np.array(trains)].sum())], pa.int64()),
                *(pa.array([_pack(x)], pa.binary()) for x in (lengths, hashes, np.concatenate(parts))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "trains", "n_train", "lengths", "words", "numbers"])

        for batch in batches:
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = text.as_py()
                found = [words.setdefault(w, len(words)) for w in tokens(t)]
                parts.append(np.array(found, dtype=np.int32))
                ids.append(doc_id)
                trains.append(bool(learn))
                size += len(t or "") + 64
                if size >= BLOCK:
                    yield block()
                    number += 1
                    words, ids, trains, parts, size = {START: 0}, [], [], [], 0
        if parts:
            yield block()

    return docs.mapInArrow(run, "block long, ids array<long>, trains array<boolean>, n_train long, lengths binary, words binary, numbers binary")


class Block:
    """A block's n-grams: for each order their hashes, counts (in training, in all texts), first places, and each token's n-gram."""

    def __init__(self, row: dict, order: int):
        self.lengths = _unpack(row["lengths"], "<i8")
        self.words = _unpack(row["words"], "<u8")
        self.numbers = _unpack(row["numbers"], "<i4").astype(np.int64)
        self.ids, self.trains = row["ids"], np.array(row["trains"], dtype=bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        learn = np.repeat(self.trains, self.lengths)
        self.at = np.arange(len(self.numbers)) - np.repeat(self.starts, self.lengths)
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        own = previous = self.words[self.numbers]
        for n in range(1, order + 1):
            if n > 1:
                # The n-gram that ends at a token: its last word after the shorter one that ends at the token before. The
                # document's start stands as one word, so a document's token k has n-grams up to order k + 2.
                before = np.concatenate([[self.words[0]], previous[:-1]])
                previous = _chain(np.where(self.at == 0, self.words[0], before), own)
            there = self.at >= n - 2
            hashes, first, back = _distinct(previous[there])
            places = np.flatnonzero(there)
            index = np.full(len(own), -1, dtype=np.int64)
            index[there] = back
            counts = [np.bincount(x, minlength=len(hashes)) for x in (back[learn[there]], back)]
            self.grams.append((hashes, np.stack(counts, axis=1), places[first], index))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, rising, a place of each, and the number of each place's value."""
    order = np.argsort(x)
    rising = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = rising[1:] != rising[:-1]
    back = np.empty(len(x), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return rising[new], order[new], back


def _chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first words and its last word's."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + (word ^ word >> np.uint64(29))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


RUNS = "node long, n int, prefix long, hashes binary, counts binary"
TOTALS = "node long, n int, prefix long, totals binary, known long"


def _planes(b: bytes, width: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, "u1").reshape(width, -1).T).view(kind).ravel()


def _packed_run(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return _pack(steps), _pack_counts(counts)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _pack(np.ascontiguousarray(counts, dtype="<i8").view(np.uint8).reshape(-1, 16).T)


def _counts(b: bytes) -> np.ndarray:
    return _planes(b, 16, "<i8").reshape(-1, 2)


def _run(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_planes(hashes, 8, "<u8"), dtype=np.uint64), _counts(counts)


def _cut(node: int, n: int, prefix: int, hashes: np.ndarray, counts: np.ndarray, ways: int, depth: int) -> Iterator[tuple]:
    """Rows of RUNS: a run cut by the digit of its hashes at `depth`, of `ways` values."""
    bits = (ways - 1).bit_length()
    digits = hashes >> np.uint64(64 - bits * depth) & np.uint64(ways - 1) if bits else np.zeros(len(hashes), dtype=np.uint64)
    bounds = np.append(np.flatnonzero(np.diff(digits, prepend=np.uint64(ways))), len(hashes)).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield (node, n, prefix * ways + int(digits[lo]), *_packed_run(hashes[lo:hi], counts[lo:hi]))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """A group's runs as one: distinct hashes, sums, where each hash of each run is, and (node, lo, hi) of the runs."""
    runs = [_run(h, c) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    distinct, back = np.unique(np.concatenate([h for h, _ in runs]), return_inverse=True)
    counts = np.concatenate([c for _, c in runs])
    sums = np.stack([np.bincount(back, weights=c, minlength=len(distinct)) for c in counts.T], axis=1).astype(np.int64)
    ends = np.cumsum([len(h) for h, _ in runs]).tolist()
    return distinct, sums, back, list(zip(table.column("node").to_pylist(), [0, *ends], ends, strict=False))


def _down(table: pa.Table, totals: np.ndarray, back: np.ndarray, places: list, known: int) -> pa.Table:
    n, prefix = table.column("n")[0].as_py(), table.column("prefix")[0].as_py()
    rows = [(node, n, prefix, _pack_counts(totals[back[lo:hi]]), known if k == 0 else 0) for k, (node, lo, hi) in enumerate(places)]
    return _table(rows, TOTALS)


def _up(ways: int, depth: int):
    """A group's runs, added up and cut by the next digit."""

    def run(table: pa.Table) -> pa.Table:
        distinct, sums, _, _ = _merged(table)
        node, n, prefix = (table.column(c)[0].as_py() for c in ("parent", "n", "prefix"))
        return _table(list(_cut(node, n, prefix, distinct, sums, ways, depth)), RUNS)

    return run


def add_up(runs: DataFrame, nodes: int, ways: int, name: str) -> DataFrame:
    """Runs (RUNS) of `nodes` nodes, cut once -> each with its totals over all nodes (TOTALS), in the order of its hashes.

    known: how many n-grams of a prefix have a total above zero, in one row of each. Every step is written."""
    levels, depth = [], 1
    while nodes > FAN:
        nodes = -(-nodes // FAN)
        runs = runs.withColumn("parent", F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(nodes)))
        levels.append(runs)
        depth += 1
        runs = materialise(runs.groupBy("n", "prefix", "parent").applyInArrow(_up(ways, depth), RUNS), name)

    def top(table: pa.Table) -> pa.Table:
        _, sums, back, places = _merged(table)
        return _down(table, sums, back, places, int((sums[:, 0] > 0).sum()))

    totals = materialise(runs.groupBy("n", "prefix").applyInArrow(top, TOTALS), name)
    for runs in reversed(levels):

        def down(table: pa.Table, above: pa.Table) -> pa.Table:
            _, _, back, places = _merged(table)
            at = np.argsort(above.column("prefix").to_numpy()).tolist()
            packed, known = above.column("totals").to_pylist(), sum(above.column("known").to_pylist())
            return _down(table, np.concatenate([_counts(packed[i]) for i in at]), back, places, known)

        above = totals.select("node", "n", "prefix", F.expr(f"prefix div {ways}").alias("below"), "totals", "known")
        totals = runs.groupBy("n", "prefix", "parent").cogroup(above.groupBy("n", "below", "node")).applyInArrow(down, TOTALS)
        totals = materialise(totals, name)
    return totals


def _totals_of(sums: pa.Table, n: int) -> np.ndarray:
    """The totals (in training, in all texts) of a block's n-grams of an order, from its rows of TOTALS."""
    at = [(p, i) for i, (k, p) in enumerate(zip(sums.column("n").to_pylist(), sums.column("prefix").to_pylist(), strict=True)) if k == n]
    packed = sums.column("totals")
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *[_counts(packed[i].as_py()) for _, i in sorted(at)]])


def _first_runs(blocks: DataFrame, ways: int) -> DataFrame:
    """RUNS of the words and pairs of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, (hashes, counts, _, _) in enumerate(Block(row, 2).grams, 1):
                    yield from _table(list(_cut(row["block"], n, 0, hashes, counts, ways, 1)), RUNS).to_batches()

    return blocks.mapInArrow(run, RUNS)


def _abroad(b: Block, n: int, shorter: np.ndarray) -> np.ndarray:
    """Which n-grams of a block other blocks may have too, given the totals of its shorter ones: those whose shorter ones others have."""
    _, counts, places, _ = b.grams[n - 1]
    elsewhere = shorter[:, 1] > b.grams[n - 2][1][:, 1]
    index = b.grams[n - 2][3]
    return elsewhere[index[places]] & elsewhere[index[places - 1]]


def _all_totals(b: Block, sums: pa.Table, order: int) -> list[np.ndarray]:
    """The totals (in training, in all texts) of all n-grams of a block up to an order; those that stayed at home have the block's counts."""
    totals = [_totals_of(sums, n) for n in (1, 2)]
    for n in range(3, order + 1):
        here = b.grams[n - 1][1].copy()
        here[_abroad(b, n, totals[-1])] = _totals_of(sums, n)
        totals.append(here)
    return totals


def _longer_runs(blocks: DataFrame, totals: DataFrame, n: int, ways: int) -> DataFrame:
    """RUNS of the n-grams of all blocks that don't stay at home."""

    def run(rows: pa.Table, sums: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in rows.to_pylist():
            b = Block(row, n)
            go = _abroad(b, n, _all_totals(b, sums, n - 1)[-1])
            out += _cut(row["block"], n, 0, b.grams[n - 1][0][go], b.grams[n - 1][1][go], ways, 1)
        return _table(out, RUNS)

    return blocks.groupBy("block").cogroup(totals.groupBy("node")).applyInArrow(run, RUNS)


class Automaton:
    """The part of the automaton that a block can walk.

    State 0 has no context, state 1 is the start of a text; then come the block's words, pairs and so on that training has.
    fail, fail_weight: of each state. For each order: the arcs' states, words, weights and next states, by the block's n-grams."""

    def __init__(self, block: Block, totals: list[np.ndarray], n_train: int, n_words: int, n_docs: int, priors: tuple[float, ...]):
        self.block = block
        order = len(totals)
        self.base = np.log10((totals[0] + ADD) / (n_train + ADD * (n_words + 1)))
        numbers, at = block.numbers, block.at
        states, counts, fails = 2, [np.array([0, n_docs])], [np.array([0, 0])]
        weighs = [0.0, priors[0]]
        of: list[np.ndarray] = []  # the state of each n-gram, as a context
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            total, (_, _, places, _) = totals[n - 1], block.grams[n - 1]
            if n < order:
                seen = total > 0
                own = np.where(seen, states + np.cumsum(seen) - 1, 0)
                states += int(seen.sum())
                shorter = np.zeros(len(total), dtype=np.int64) if n == 1 else of[n - 2][block.grams[n - 2][3][places]]
                counts.append(total[seen])
                fails.append(shorter[seen])
                weighs += [priors[n - 1]] * int(seen.sum())
                of.append(own)
                following = own
            else:
                following = of[n - 2][block.grams[n - 2][3][places]]
            if n == 1:
                source, weight = np.zeros(len(total), dtype=np.int64), self.base
            else:
                first = at[places] == 0
                context = block.grams[n - 2][3][np.maximum(places - 1, 0)]
                source = np.where(first, 1, of[n - 2][context])
                below = self.arcs[n - 2][2][block.grams[n - 2][3][places]]
                c = np.where(first, n_docs, totals[n - 2][context])
                with np.errstate(divide="ignore"):
                    weight = np.log10((total + priors[n - 2] * 10.0**below) / (c + priors[n - 2]))
            self.arcs.append((source, numbers[places], weight, following))
        self.totals = totals
        counts_, m = np.concatenate(counts), np.array(weighs)
        self.fail = np.concatenate(fails).tolist()
        self.fail_weight = np.where(m > 0, np.log10(np.where(m > 0, m, 1) / (counts_ + np.where(m > 0, m, 1))), 0.0).tolist()

    def _laid_out(self, lo: int, hi: int) -> tuple[dict[int, int], list[float], list[int]]:
        """The arcs from states other than 0 that tokens lo to hi may take: their numbers by state and word, weights, next states."""
        width, parts = len(self.block.words), []
        for n, (source, word, weight, following) in enumerate(self.arcs[1:], 2):
            index = self.block.grams[n - 1][3][lo:hi]
            index = index[index >= 0]
            index = index[self.totals[n - 1][index] > 0]
            parts.append((source[index] * width + word[index], weight[index], following[index]))
        keys, weights, following = (np.concatenate(x).tolist() for x in zip(*parts, strict=True))
        return dict(zip(keys, range(len(keys)), strict=True)), weights, following

    def traverse(self) -> np.ndarray:
        """The log10 probability of each text, read from left to right with the state carried along."""
        fail, fail_weight, numbers, width = self.fail, self.fail_weight, self.block.numbers, len(self.block.words)
        # State 0 has an arc for each of the block's words.
        _, word, weight, following = self.arcs[0]
        root_weight, root_next = np.zeros(width), np.zeros(width, dtype=np.int64)
        root_weight[word], root_next[word] = weight, following
        root_weight, root_next = root_weight.tolist(), root_next.tolist()
        scores = np.zeros(len(self.block.lengths))
        ends = (self.block.starts + self.block.lengths).tolist()
        doc, state, total, at = 0, 1, 0.0, 0
        while at < len(numbers):
            upto = min(len(numbers), at + SLICE)
            arcs, weights, nexts = self._laid_out(at, upto)
            find = arcs.get
            while at < upto:
                # A text that goes on beyond the slice keeps its state.
                stop = min(ends[doc], upto)
                for w in numbers[at:stop].tolist():
                    arc = find(state * width + w) if state else None
                    while arc is None and state:
                        total += fail_weight[state]
                        state = fail[state]
                        arc = find(state * width + w) if state else None
                    if arc is None:
                        total += root_weight[w]
                        state = root_next[w]
                    else:
                        total += weights[arc]
                        state = nexts[arc]
                at = stop
                if at == ends[doc]:
                    scores[doc] = total
                    doc, state, total = doc + 1, 1, 0.0
        return scores


def _scored(priors: tuple[float, ...], n_train: int, n_words: int, n_docs: int):
    order = len(priors) + 1

    def run(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        rows = blocks.to_pylist()
        if not rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        b = Block(rows[0], order)
        totals = _all_totals(b, sums, order)
        a = Automaton(b, [t[:, 0] for t in totals], n_train, n_words, n_docs, priors)
        known, index = totals[0][:, 0] > 0, b.grams[0][3]
        columns = [b.ids, b.lengths, np.add.reduceat(known[index].astype(np.int64), b.starts), np.add.reduceat(a.base[index], b.starts), a.traverse()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def score_texts(docs: DataFrame, trains: F.Column, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from the rows where `trains` holds.

    priors: the weight of the prior for each order from two on, so one less than the order of the n-grams."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    blocks = materialise(_blocks(rows), "lm-blocks")
    n = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.size(F.filter("trains", lambda x: x))), F.lit(0)).alias("docs")).first()
    # A few blocks need few ranges.
    ways = min(FAN, 1 << (2 * int(n["blocks"])).bit_length())
    totals = add_up(_first_runs(blocks, ways), int(n["blocks"]), ways, "lm-sums")
    n_words = int(totals.where("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0])
    for k in range(3, len(priors) + 2):
        totals = totals.unionByName(add_up(_longer_runs(blocks, totals, k, ways), int(n["blocks"]), ways, "lm-sums"))
    run = _scored(tuple(priors), int(n["n_train"]), n_words, int(n["docs"]))
    out = blocks.groupBy("block").cogroup(totals.groupBy("node")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(n["n_train"])).cast("long"))
