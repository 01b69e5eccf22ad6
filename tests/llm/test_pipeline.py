"""The pipeline's stages, each against plain Python on its own input, and the entry's guard."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import TOKENIZERS, make, words
from test_rows import brute_lines, reshare
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline


def documents(spark):
    rng, rows = random.Random(11), []
    for i in range(120):
        body = [words(rng, 25) for _ in range(4)]
        if i % 4 == 0:
            body.insert(rng.randint(0, 4), f"Notice {i} of the public office in town")
        rows.append((i, "\n".join(body), "en", rng.choice(["a", "b", "c"])))
    for i in range(20):
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "en", "a"))
        rows.append((300 + i, rows[i][1], "en", "b"))
    rows += [(400, None, "en", "a"), (401, "123 456", "en", "a"), (402, "", None, None)]
    return make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def test_stages(spark, tmp_path):
    docs, tables = documents(spark), []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet") if not tables else tables[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    start, spoken, lines, single, mixed, ids = ([r for r in t.collect()] for t in (docs, *tables))
    assert {r.doc_id for r in start} - {r.doc_id for r in spoken} == {400, 401, 402}
    assert Counter((r.doc_id, r.text) for r in lines) == Counter(brute_lines([(r.doc_id, r.text) for r in spoken]))
    assert all(r.n_chars == len(r.text) for r in lines)
    assert sorted(r.doc_id for r in single) == list(range(120))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in single:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    for s, t in reshare(sizes).items():
        assert abs(taken[s] - t) <= 120
    lib = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    want = Counter()
    for r in mixed:
        i = lib.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(i), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in ids) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in ids)


def test_no_documents(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_has_a_query_for_each_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dup", "mixing", "bpe"]
