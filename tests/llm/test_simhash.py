import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import make, words

from streetweave.llm import simhash
from streetweave.llm.components import connected_components


def fingerprint(text, k):
    b = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(b[i : i + k]) for i in range(len(b) - k + 1)] if len(b) >= k else [b" ".join(b)] if b else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute(rows, k, budget):
    """(fingerprint, smallest id reachable) of each row."""
    fps = [fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def copies(n, seed):
    """Texts with copies that differ in a few words."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        w = words(rng, rng.randint(1, 60)).split()
        out.append(" ".join(w))
        for _ in range(rng.choice((0, 0, 1, 4))):
            c = list(w)
            if rng.random() < 0.7:
                c[rng.randrange(len(c))] = "X"
            out.append(" ".join(c))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize(("budget", "crowd"), [(2, 8192), (2, 4), (6, 16)])
def test_links_equal_all_pairs(spark, budget, crowd):
    rows = copies(250, budget)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_dup_64(docs, 3, budget, crowd).collect()
    assert Counter(map(tuple, got)) == brute(rows, 3, budget)


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = simhash.near_dup_64(edge_docs, 3, 2).collect()
    assert Counter(map(tuple, got)) == brute([r[:2] for r in edge_rows], 3, 2)
    assert simhash.near_dup_64(no_docs).count() == 0 and simhash.near_dup(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and 7 not in ids and ids[0] == 1 and 1 not in ids and 2 not in ids


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    base = [words(rng, 200) for _ in range(60)]
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    for i in range(30):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "en", "a"))
        rows.append((200 + i, base[i], "en", "b"))
    kept = {r.doc_id for r in simhash.keep_one(make(spark, rows)).collect()}
    assert kept == set(range(60))


def test_pairs_are_confirmed_by_their_shingles(spark):
    """Pairs just above the similarity go, those below it stay, and so do texts that share only a repeated passage."""
    rng = random.Random(6)
    rows, gone, at = [], set(), 0
    for share in (0.75, 0.77, 0.79, 0.81, 0.83, 0.85):
        for _ in range(20):
            w = [f"{x}{rng.randrange(10**6)}" for x in words(rng, 404).split()]
            n = round(400 * 2 * share / (1 + share))  # shingles that both have, of 400
            rows += [(at, " ".join(w), "en", "a"), (at + 1, " ".join(w[: n + 4] + [f"{x}new" for x in w[n + 4 :]]), "en", "a")]
            if n / (800 - n) >= 0.8:
                gone.add(at + 1)
            at += 2
    for i in range(2):
        rows.append((1000 + i, "all rights reserved here today " * 200 + " ".join(f"own{i}w{k}" for k in range(150)), "en", "a"))
    kept = {r.doc_id for r in simhash.keep_one(make(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - gone


def test_dense_cluster(spark):
    """Many copies that differ from one another, in few tasks' cells."""
    rng = random.Random(4)
    w = words(rng, 300).split()
    rows = [(0, " ".join(w))]
    for i in range(1, 400):
        c = list(w)
        c[rng.randrange(300)] = f"w{i}"
        rows.append((i, " ".join(c)))
    got = simhash.near_dup(spark.createDataFrame(rows, "doc_id long, text string"), crowd=50).collect()
    assert {r.component_id for r in got} == {0}


def test_walk_against_all_pairs():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 16, 300, dtype=np.uint64) << np.uint64(48))
    groups, pairs = simhash.Groups(len(keys)), set()

    def close(i, j):
        pairs.update(map(tuple, np.sort(np.stack([i, j], 1), axis=1).tolist()))
        return np.zeros(len(i), dtype=bool)  # nothing is linked, so nothing is left out

    z = np.zeros(1, dtype=np.int64)
    simhash.walk(keys, 0, 16, 3, (z, z + len(keys), z, z + len(keys), z), close, groups)
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if bin(int(keys[i] ^ keys[j])).count("1") <= 3}
    assert pairs == want


@pytest.mark.parametrize(("rows", "most"), [(3_700, 40), (12_000, 80)])
def test_node_pairs_stay_few(rows, most):
    """One cell of a band's trie: all pairs of near keys, from far fewer node pairs a row than there are near the leaves."""
    followed, pairs = [], []

    class Counted(simhash.Groups):
        def whole(self, lo, hi):
            followed.append(len(lo))
            return super().whole(lo, hi)

    def close(i, j):
        pairs.append(np.sort(np.stack([i, j], 1), axis=1))
        return np.arange(0)  # nothing is linked, so nothing is left out

    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 26, rows, dtype=np.uint64) << np.uint64(32))
    z = np.zeros(1, dtype=np.int64)
    simhash.walk(keys, 6, 32, 4, (z, z + rows, z, z + rows, z), close, Counted(rows))
    want = [np.stack([np.full(k, i), i + 1 + near], 1) for i in range(rows) if (k := len(near := np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 4)))]
    assert np.array_equal(np.unique(np.concatenate(pairs), axis=0), np.concatenate(want))
    assert sum(followed) / 2 < most * rows


def test_blocks_of_unequal_ranges():
    """Nodes of all sizes, full of equal keys, at the end of the keys too: each near pair comes out once."""
    rng = np.random.default_rng(8)
    keys = np.sort(np.repeat(rng.integers(0, 1 << 7, 60, dtype=np.uint64) << np.uint64(57), rng.integers(1, 40, 60)))
    cuts = np.unique(np.concatenate([[0, len(keys)], rng.integers(0, len(keys), 90)]))
    lo, hi = cuts[:-1], cuts[1:]
    a, b = np.triu_indices(len(lo))
    got = [np.stack(x, 1) for x in simhash._compared(keys, lo[a], hi[a], lo[b], hi[b], 2, simhash.Groups(len(keys)))]
    want = np.argwhere(np.triu(np.bitwise_count(keys[:, None] ^ keys) <= 2, 1))
    got = np.concatenate(got)
    assert np.array_equal(got[np.lexsort((got[:, 1], got[:, 0]))], want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, x) for x in range(201, 260)] + [(500, 500), (600, 601), (601, 600)]
    edges += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert set(got) == nodes
    assert len({(find(x), got[x]) for x in nodes}) == len({find(x) for x in nodes}) == len({got[x] for x in nodes})


def test_no_pair_is_lost_in_groups_of_loose_copies(spark):
    """Variants of a text that are near it, but mostly not near each other, and chains: components are those of all pairs."""
    rng = random.Random(21)
    rows = []
    for g in range(3):
        base = words(rng, 150).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w)))
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    want = {rows[k][0]: rows[x][0] for k, x in enumerate(label)}
    got = {r.doc_id: r.component_id for r in simhash.near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 3 < len(set(want.values())) < len(rows)


def test_pairs_come_out_once():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    b = a ^ np.packbits(rng.random((300, 256)) < 0.08, axis=1)
    payload = np.concatenate([a, b]).view(np.uint64)
    i, j = np.arange(300), np.arange(300, 600)
    first = simhash._first_trie(payload, i, j, 32, 4)
    for k in range(300):
        bits = np.unpackbits(a[k] ^ b[k]).reshape(8, 32)
        meets = [t * 5 + u for t in range(8) if bits[t].sum() <= 4 for u in range(5) if not bits[t, 6 * u : 6 * u + 6].any()]
        assert not meets or first[k] == meets[0]
