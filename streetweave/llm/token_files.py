"""Token ids in flat binary files, with 64-bit document offsets, memory-mapped.

The documents are range-partitioned by id. Each partition encodes its texts once and writes two files
to the shared folder: `.bin`, the ids one after another as little-endian unsigned integers (16 bits
where the vocabulary allows), and `.idx`, for each document its id, the offset of its first token in
the partition, and whether the id is null. A manifest holds the partitions in order with their first
token, the prefix sum of the token counts before; a row for each PART_BYTES of text is all that the driver
holds. Files get fresh names and count once the manifest
names them, so attempts of lost or repeated tasks do no harm.

Defined results: a null text is the empty text, which holds the end id alone. Null ids come first.
Repeated rows are separate documents; rows of one id are ordered by their text's hash. An empty table
gives an empty manifest. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streetweave.llm.bpe_codec import byte_alphabet
from streetweave.llm.common import LocalView, prepare, scratch, write_shared

#: Words, with their ids, that a task keeps at hand.
CACHE = 400_000
#: Bytes of ids after which a task writes them out.
CHUNK = 8 << 20
#: Bytes of text in a partition, about, so that a task's work doesn't grow with the corpus.
PART_BYTES = 256 << 20
END = "</w>"
# Fixed value: the pattern by which the tokenizer with word ends splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """A lower-casing BPE with word ends, read from a file of the `tokenizers` library.

    White space parts the text and is dropped, so each word's ids are looked up on their own. Texts
    with characters on which Unicode versions may differ, or special tokens, go to the library whole.
    The word end is the byte 0xFF here, which UTF-8 never has; joining it to a word's last byte comes
    before every merge."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == PATTERN and spec["model"].get("end_of_word_suffix") == END
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._simple = re.compile(r"[\x00-\x1b\x20-ɏ]*")
        self._cache: dict[str, bytes] = {}
        if self.known:
            self._pieces = regex.compile(PATTERN)
            of = byte_alphabet()
            plain = lambda t: bytes(of[c] for c in t.removesuffix(END)) + b"\xff" * t.endswith(END)
            ids = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255)]
            order += [plain(m[0]) + plain(m[1]) for m in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])]
            ranks = {w: r for r, w in enumerate(dict.fromkeys(order))}
            self._merges = tiktoken.Encoding("word-ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self._ids = [ids.get(w, 0).to_bytes(4, "little") for w in ranks]

    def _word(self, word: str) -> bytes:
        pieces = [word] if word.isascii() and word.isalpha() else self._pieces.findall(word)
        of, merge = self._ids.__getitem__, self._merges.encode_single_piece
        return b"".join([b"".join(map(of, merge(p.encode() + b"\xff"))) for p in pieces])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        simple = self.known and self._simple.fullmatch(text) is not None
        if not simple or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        words = text.lower().split()
        cache = self._cache
        found = list(map(cache.get, words))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for i, x in enumerate(found):
                if x is None:
                    x = found[i] = self._word(words[i])
                    if len(words[i]) <= 64:
                        cache[words[i]] = x
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _partitions(docs: DataFrame) -> int:
    """One for each PART_BYTES of text, and the session's number of shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(-(-size // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write_token_files(docs: DataFrame, path: str, end_id: int, where: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into files below `where` (a fresh shared folder by default).

    Returns the manifest, a row for each partition: part, base (tokens before it), n_docs, n_tokens, bits, uri.
    It has as many rows as partitions and also lies beside the files as manifest.json."""
    spark = docs.sparkSession
    prepare(spark)
    where = where or scratch(spark, "tokens")
    n = partitions or _partitions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        kind = "<u2" if max(e.size - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        uri = f"{where}/part-{part:06d}-{uuid.uuid4().hex}"
        names: list = []
        counts: list[int] = []

        def ids() -> Iterator[bytes]:
            held: list[bytes] = []
            size = 0
            for batch in batches:
                names.extend(batch.column(0).to_pylist())
                for text in batch.column(1):
                    raw = e.encode(text.as_py() or "") + end
                    counts.append(len(raw) // 4)
                    held.append(raw)
                    size += len(raw)
                    if size > CHUNK:
                        yield np.frombuffer(b"".join(held), dtype="<u4").astype(kind).tobytes()
                        held, size = [], 0
            yield np.frombuffer(b"".join(held), dtype="<u4").astype(kind).tobytes()

        write_shared(uri + ".bin", ids())
        if not counts:
            return
        index = np.zeros((len(counts) + 1, 3), dtype="<i8")
        index[:-1, 0] = [x if x is not None else 0 for x in names]
        index[1:, 1] = list(accumulate(counts))
        index[:-1, 2] = [x is None for x in names]
        write_shared(uri + ".idx", [index.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, len(counts), sum(counts), 8 * np.dtype(kind).itemsize, uri)], names=["part", "n_docs", "n_tokens", "bits", "uri"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash parts rows that share one id; sorting by it too orders them.
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    parts = sorted(rows.select("doc_id", "text").mapInArrow(run, "part long, n_docs long, n_tokens long, bits long, uri string").collect())
    bases = [0, *accumulate(p.n_tokens for p in parts)]
    manifest = [(p.part, base, p.n_docs, p.n_tokens, p.bits, p.uri) for p, base in zip(parts, bases, strict=False)]
    schema = "part long, base long, n_docs long, n_tokens long, bits long, uri string"
    write_shared(f"{where}/manifest.json", [json.dumps([dict(zip((f.split()[0] for f in schema.split(", ")), m, strict=True)) for m in manifest]).encode()])
    return spark.createDataFrame(manifest, schema).repartition(max(1, len(manifest)))


def open_manifest(spark: SparkSession, where: str) -> DataFrame:
    """The manifest of files written before."""
    text = "".join(r.value for r in spark.read.text(f"{where}/manifest.json").collect())
    rows = [(m["part"], m["base"], m["n_docs"], m["n_tokens"], m["bits"], m["uri"]) for m in json.loads(text)]
    return spark.createDataFrame(rows, "part long, base long, n_docs long, n_tokens long, bits long, uri string")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents in the files of a manifest: doc_id, start, n_tokens, ids_crc32, and ids (with_ids).

    Both files of a partition are memory-mapped; a document's ids are a slice of the map."""
    prepare(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                with LocalView(m["uri"] + ".bin") as at, LocalView(m["uri"] + ".idx") as index_at:
                    ids = np.memmap(at, dtype="<u2" if m["bits"] == 16 else "<u4", mode="r")
                    index = np.memmap(index_at, dtype="<i8", mode="r").reshape(-1, 3)
                    for lo in range(0, m["n_docs"], 256):
                        part = np.array(index[lo : lo + 257])
                        starts, n = part[:-1, 1], np.diff(part[:, 1])
                        pieces = [ids[s : s + k].astype("<u4") for s, k in zip(starts, n, strict=True)]
                        columns = [
                            pa.array(part[:-1, 0], mask=part[:-1, 2].astype(bool)),
                            pa.array(starts + m["base"]),
                            pa.array(n),
                            pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.array([p.tolist() for p in pieces], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
