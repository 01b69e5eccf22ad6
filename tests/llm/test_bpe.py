import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import TOKENIZERS
from tokenizers import Tokenizer

from streetweave.llm import bpe_codec, token_files

BYTE, WORD = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"
PIECES = ["hello", " ", "  ", "\n", "\t", "World", "'s", "'", "RE", "123", "!!", "é", "é", "日本語", "😀", "<|endoftext|>", "\x85", "\x1c", "a" * 40, "AbC", "ß", "　", "don't", "'LL", "²", "\xa0", "İ", "Σ", "x"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n, pieces, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [2, 16, 100])
def test_tree_concatenation_equals_the_library(leaf):
    own, lib = bpe_codec.Codec(BYTE, leaf), library(BYTE)
    for t in random_texts(500, PIECES, leaf):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t
        assert own.decode(np.array(ids, dtype=np.uint32)) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "theINGeda"])
def test_unsplit_text(letters):
    own, lib, rng = bpe_codec.Codec(BYTE, 64), library(BYTE), random.Random(1)
    for n in (63, 64, 65, 1000, 20_000):
        t = "".join(rng.choice(letters) for _ in range(n))
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_rows(spark, edge_docs, edge_rows, no_docs):
    lib = library(BYTE)
    want = []
    for r in edge_rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((str(r[0]), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = bpe_codec.encode_texts(edge_docs, BYTE, leaf=512)
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()]
    assert Counter(got) == Counter(want)
    texts = bpe_codec.decode_ids(out, BYTE).collect()
    assert Counter(r.text for r in texts) == Counter(r[1] or "" for r in edge_rows)
    assert bpe_codec.encode_texts(no_docs, BYTE).count() == 0


def test_word_encoder_equals_the_library():
    own, lib = token_files.WordEncoder(WORD), library(WORD)
    assert own.known
    texts = random_texts(1500, PIECES, 5) + [f"{a}{chr(c)}b" for c in range(0x250) for a in ("", "a", "!")]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, edge_docs, edge_rows, no_docs):
    lib = library(WORD)
    manifest = token_files.write_token_files(edge_docs, WORD, 2, partitions=3)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in edge_rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    want = Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in edge_rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    where = manifest.first().uri.rpartition("/")[0]
    again = token_files.read_token_files(token_files.open_manifest(spark, where), with_ids=False).collect()
    assert {(r.start, r.ids_crc32) for r in again} == {(r.start, r.ids_crc32) for r in got}
    empty = token_files.write_token_files(no_docs, WORD, 2, partitions=2)
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0


def test_partitions_grow_with_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(50)], "doc_id long, text string")
    assert token_files._partitions(docs) == 4  # the session's number
    monkeypatch.setattr(token_files, "PART_BYTES", 5_000)
    assert token_files._partitions(docs) == 10 and token_files._partitions(docs.union(docs)) == 20
    got = token_files.read_token_files(token_files.write_token_files(docs, WORD, 2), with_ids=False).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(i, 201 * i) for i in range(50)]
