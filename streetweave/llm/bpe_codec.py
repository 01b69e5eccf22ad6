"""Byte-level BPE of whole texts by tree concatenation, and its inverse.

A text longer than a leaf is halved until the leaves are short. Leaves are encoded on their own, in
parallel, and neighbours are joined up the tree: the text around a join is encoded again in a window
that grows, in steps at word starts, until its first stretch equals what the left side has there and
its last stretch what the right side has. Word starts (a blank after something else) split the
tokenizer's scan whatever surrounds them, so an agreeing window makes the joined ids those of the whole
text. Inside one long run of ASCII letters there is no such place; there the window grows by tokens, and
agreement in a token on either side suffices, as ids are a text's BPE exactly if each neighbouring pair
of them is the BPE of its own text. A window that reaches both ends is the whole encoding.

Defined results: a null text is the empty text, without ids. Special tokens' strings in a text become
their ids, as in the tokenizer's default. Repeated rows are encoded alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import prepare

#: Characters of a leaf.
LEAF = 8192
#: A word start: white space that any Unicode version knows as such, after what none does.
_START = re.compile(r"(?<=\S)[ \t\n\r]")
_LETTERS = re.compile(r"[A-Za-z]+")
# Fixed value: the pattern by which this family of byte-level tokenizers splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of(token: str, of: dict[str, int]) -> bytes:
    return bytes(of[c] for c in token)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte -> that byte: bytes that print stand for
    themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE read from a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, leaf: int = LEAF):
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a plain byte-level tokenizer is needed")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {_bytes_of(t, alphabet): i for t, i in vocab.items() if t not in self.special}
        self.leaf = leaf
        self._encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.words = [b""] * size
        for word, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.words[i] = word
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text that is encoded in one piece."""
        return self._encoding.encode_to_numpy(text, allowed_special="all")

    def encode(self, text: str, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """The ids of a whole text."""
        if len(text) <= self.leaf:
            return self.plain(text)
        cuts = self._cuts(0, len(text))
        spans = list(zip(cuts, cuts[1:], strict=False))
        leaves = [text[a:b] for a, b in spans]
        ids = list((pool.map if pool and len(leaves) > 8 else map)(self.plain, leaves))
        while len(spans) > 1:
            joined, ends = [], []
            for k in range(0, len(spans) - 1, 2):
                (a, m), (_, b) = spans[k], spans[k + 1]
                joined.append(self.join(text, a, m, b, ids[k], ids[k + 1]))
                ends.append((a, b))
            if len(spans) % 2:
                joined.append(ids[-1])
                ends.append(spans[-1])
            ids, spans = joined, ends
        return ids[0]

    def _cuts(self, a: int, b: int) -> list[int]:
        """Halves of halves, down to leaves."""
        parts = 1
        while (b - a) > self.leaf * parts:
            parts *= 2
        return [a + (b - a) * k // parts for k in range(parts + 1)]

    def _back(self, ids: np.ndarray, n: int) -> int | None:
        """How many of the last ids make exactly n bytes; None if a token crosses that place."""
        k, total = 0, 0
        while total < n and k < len(ids):
            k += 1
            total += self.lengths[ids[-k]]
        return k if total == n else None

    def _ahead(self, ids: np.ndarray, n: int) -> int | None:
        k, total = 0, 0
        while total < n and k < len(ids):
            total += self.lengths[ids[k]]
            k += 1
        return k if total == n else None

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[a:b] from those of its parts, split at m."""
        by_letters = self._join_letters(text, a, m, b, left, right)
        if by_letters is not None:
            return by_letters
        reach = 64
        while True:
            lo, hi = max(a, m - reach), min(b, m + reach)
            before = [x.start() for x in _START.finditer(text, lo, m) if x.start() > a]
            after = [x.start() for x in _START.finditer(text, m, hi) if x.start() > m]
            # Two word starts on either side: the window runs over the outer ones and must agree up to the inner ones.
            if (lo == a or len(before) >= 3) and (hi == b or len(after) >= 3):
                s = before[-3] if len(before) >= 3 else a
                e = after[2] if len(after) >= 3 else b
                window = self.plain(text[s:e])
                keep_left = self._back(left, len(text[s:m].encode()))
                keep_right = self._ahead(right, len(text[m:e].encode()))
                if keep_left is not None and keep_right is not None:
                    own_left, own_right = left[len(left) - keep_left :], right[:keep_right]
                    first = self._ahead(window, len(text[s : before[-2]].encode())) if s > a else 0
                    last = self._back(window, len(text[after[1] : e].encode())) if e < b else 0
                    if first is not None and last is not None and self._same(window[:first], own_left) and self._same(window[len(window) - last :][::-1], own_right[::-1]):
                        return np.concatenate([left[: len(left) - keep_left], window, right[keep_right:]])
            if lo == a and hi == b:
                return self.plain(text[a:b])
            reach *= 2

    @staticmethod
    def _same(part: np.ndarray, of: np.ndarray) -> bool:
        return len(part) <= len(of) and bool((part == of[: len(part)]).all())

    def _join_letters(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """The join inside a run of ASCII letters that fills the surroundings of m, or None."""
        n = 8
        while n <= 4096 and _LETTERS.fullmatch(text, max(a, m - 64 * n), min(b, m + 64 * n)):
            k, j = min(n, len(left)), min(n, len(right))
            s, e = m - int(self.lengths[left[len(left) - k :]].sum()), m + int(self.lengths[right[:j]].sum())
            if s <= a or e >= b or not _LETTERS.fullmatch(text, s, e):
                return None
            window = self.plain(text[s:e])
            if len(window) and window[0] == left[-k] and window[-1] == right[j - 1]:
                return np.concatenate([left[: len(left) - k], window, right[j:]])
            n *= 2
        return None

    def decode(self, ids: np.ndarray) -> str:
        words = self.words
        return b"".join([words[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def encode_texts(docs: DataFrame, path: str, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (binary, little-endian unsigned 32-bit; with_ids), n_tokens, ids_sha256, decoded_sha256."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for text in batch.column(1):
                    ids = c.encode(text.as_py() or "", pool)
                    raw = ids.astype("<u4").tobytes()
                    if with_ids:
                        out[0].append(raw)
                    out[1].append(len(ids))
                    out[2].append(hashlib.sha256(raw).hexdigest())
                    out[3].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                columns = [pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
                names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns[1 - with_ids :]], names=names[:1] + names[2 - with_ids :])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + "ids binary, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text. Null ids are those of the empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
