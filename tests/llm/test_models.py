"""Language-model scores and embedding near-dedup against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import make, words
from pyspark.sql import functions as F

from streetweave.llm import embed_dedup, lm_score


class Automaton:
    """States are the last words read, each with arcs by word and a failure weight; one state at a time is carried."""

    def __init__(self, texts, priors):
        self.order, self.priors = len(priors) + 1, priors
        order = self.order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = [lm_score.START] * (order - 1) + lm_score.tokens(t)
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    gram = tuple(w[i - n + 1 : i + 1])
                    if n < 2 or gram[:-1].count(lm_score.START) <= 1:
                        self.counts[n][gram] += 1
        self.docs = len(texts)
        self.total, self.known = sum(self.counts[1].values()), len(self.counts[1])

    def base(self, w):
        return math.log10((self.counts[1][(w,)] + 0.1) / (self.total + 0.1 * (self.known + 1)))

    def p(self, state, w):
        if not state:
            return 10 ** self.base(w)
        c = self.docs if state == (lm_score.START,) else self.counts[len(state)][state]
        m = self.priors[len(state) - 1]
        return (self.counts[len(state) + 1][(*state, w)] + m * self.p(state[1:], w)) / (c + m)

    def score(self, text):
        state, total = (lm_score.START,), 0.0
        for w in lm_score.tokens(text):
            total += math.log10(self.p(state[-(self.order - 1) :], w))
            state = (*state, w)[-(self.order - 1) :]
        return total


def corpus(n=150):
    rng = random.Random(8)
    return [(i, words(rng, rng.randint(0, 40)).title() if i % 9 else "\tThe\nan  er ", "en", "a") for i in range(n)]


@pytest.mark.parametrize(("block", "fan", "priors"), [(1 << 23, 256, (20.0, 5.0)), (2000, 4, (20.0, 5.0)), (700, 2, (20.0,)), (2000, 4, (20.0, 5.0, 2.0))])
def test_scores(spark, monkeypatch, block, fan, priors):
    rows = corpus()
    learn = [t for i, t, *_ in rows if i % 10]
    a = Automaton(learn, priors)
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "FAN", fan)
    monkeypatch.setattr(lm_score, "SLICE", 100)
    docs = make(spark, rows).repartition(3)
    got = {r.doc_id: r for r in lm_score.score_texts(docs, F.col("doc_id") % 10 != 0, priors=priors).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w, r = lm_score.tokens(t), got[i]
        assert (r.n_tokens, r.train_tokens) == (len(w), a.total)
        assert r.n_known == sum(a.counts[1][(x,)] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(map(a.base, w)))
        assert r.score == pytest.approx(a.score(t))


def test_sent_rows_grow_with_the_corpus(spark, monkeypatch):
    """At four times the blocks, four times the rows, but for another level of the tree: never the square."""
    monkeypatch.setattr(lm_score, "BLOCK", 700)
    monkeypatch.setattr(lm_score, "FAN", 8)
    sent = []
    for n in (100, 400):
        docs = make(spark, [(i, words(random.Random(i), 30), "en", "a") for i in range(n)]).repartition(2).select("doc_id", "text", F.lit(True).alias("trains"))
        blocks = lm_score._blocks(docs).cache()
        k = blocks.count()
        runs = lm_score._first_runs(blocks, 8).cache()
        assert runs.count() <= k * 8 * 2
        totals = lm_score.add_up(runs, k, 8, "lm-test")
        assert totals.count() == runs.count() and totals.where("n = 1").agg(F.sum("known")).first()[0] > 0
        sent.append((k, runs.count()))
    assert sent[1][1] <= 1.1 * sent[0][1] * sent[1][0] / sent[0][0]


def test_probabilities_sum_to_one(spark):
    a = Automaton([t for _, t, *_ in corpus()], (20.0, 5.0))
    for state in [(), (lm_score.START,), (b"the",), (b"anan",), (lm_score.START, b"the"), (b"the", b"an")]:
        total = sum(a.p(state, w) for (w,) in a.counts[1]) + a.p(state, b"never seen")
        assert total == pytest.approx(1)


def test_score_edges(spark, edge_docs, edge_rows, no_docs):
    out = lm_score.score_texts(edge_docs, F.col("doc_id") != 3).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r[0], len((r[1] or "").split()) + 1) for r in edge_rows)
    assert all(r.score <= 0 and math.isfinite(r.score) and r.train_tokens == out[0].train_tokens for r in out)
    assert lm_score.score_texts(no_docs, F.lit(True)).count() == 0
    untrained = lm_score.score_texts(edge_docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in untrained)


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of each row."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = [k for k, g in enumerate(good) if g]
    x = [np.array(rows[k][1], dtype=float) for k in at]
    x = [v / np.abs(v).max() for v in x]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, i in enumerate(at):
        for b in range(a):
            if len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= least - 1e-12:
                n[i] += 1
                n[at[b]] += 1
                parent[find(i)] = find(at[b])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    out = [(i, n[k], low.get(find(k)) if good[k] else i) for k, (i, _) in enumerate(rows)]
    return Counter((i, links, c, i is not None and i == c) for i, links, c in out)


@pytest.mark.parametrize("block", [2048, 5])
def test_links_of_vectors(spark, block):
    rng = np.random.default_rng(block)
    base = rng.standard_normal((12, 24))
    rows = [(k, (base[k % 12] + 0.05 * rng.standard_normal(24)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(300 + k, rng.standard_normal(24).astype(np.float32).tolist()) for k in range(60)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] + [1.0] * 23), (404, [None] + [1.0] * 23), (405, [float("inf")] * 24), (None, rows[1][1]), (None, None), (406, [3.0]), (407, [1.0]), (408, [1e30] * 24), (409, [1e-30] * 24)]
    df = spark.createDataFrame([(i, v, 0, None, None) for i, v in rows], "vec_id long, embedding array<float>, label int, node long, keys string")
    got = Counter(map(tuple, embed_dedup.near_dup_vectors(df, block=block).collect()))
    assert got == brute(rows)
    assert embed_dedup.near_dup_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at cosine 0.95 share a bucket in nine of ten cases at least."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    args = (embed_dedup.TABLES, embed_dedup.PROJECTIONS, embed_dedup.WIDTH)
    assert (embed_dedup.buckets(a, *args) == embed_dedup.buckets(c, *args)).any(axis=1).mean() >= 0.9
