"""URL rules looked up in a sorted array of 64-bit digests.

The rule file has three memory-mapped parts: sorted xxHash64 keys, 64-bit string offsets, and the
rules' full strings. A probe hashes each (host suffix, path prefix) of a URL, finds it by
vectorised binary search, and compares the stored string, so a digest collision cannot decide.

Defined results: a null URL, an empty one and one without `://` have an empty host and path, fit no
rule and get the default verdict. Repeated rows are judged alike; an empty table gives an empty
result; input columns beside `page_id` and `url` are not read. Of a very long host only the suffixes that a
rule's host can equal are looked up, those of at most as many labels as the longest rule's, and of a path the
prefixes of the rules' lengths: memory grows with the URL's length alone. Of rules that fit a URL the longest
host + path wins, then the longer host. Two rules with one host and path: the later one holds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import LocalView, prepare, scratch, write_shared

MAGIC = b"URLDIG02"
UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) by the rules of the module; A-Z of the host are lower-cased."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(UPPER), path


def write_rules(uri: str, rules: Iterable[tuple[str, str]]) -> None:
    """rules: (verdict, host + path). Writes the digest array."""
    kept = {rule: verdict for verdict, rule in rules}
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), f"{v} {r}".encode()) for r, v in kept.items())
    keys = np.array([k for k, _ in rows], dtype="<u8")
    offsets = np.zeros(len(rows) + 1, dtype="<i8")
    offsets[1:] = np.cumsum([len(s) for _, s in rows])
    lengths = np.array(sorted({len(r) - len(_host(r)) for r in kept}), dtype="<i8")
    labels = max((_host(r).count(".") + 1 for r in kept), default=0)
    head = MAGIC + struct.pack("<qqq", len(rows), len(lengths), labels)
    write_shared(uri, [head, lengths.tobytes(), keys.tobytes(), offsets.tobytes(), b"".join(s for _, s in rows)])


def _host(rule: str) -> str:
    return rule.partition("/")[0]


class RuleIndex:
    """The memory-mapped digest array."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a URL digest file")
        n, m, self.labels = struct.unpack("<qqq", bytes(raw[8:32]))
        at = 32
        self.lengths = raw[at : at + 8 * m].view("<i8").tolist()
        at += 8 * m
        self.keys = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view("<i8")
        self.strings = raw[at + 8 * (n + 1) :]

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Host suffixes of at most as many labels as a rule's, each with the path's prefixes of the rules' lengths."""
        host = ".".join(host.rsplit(".", self.labels)[-self.labels :]) if self.labels else ""
        while host:
            for n in self.lengths:
                if len(path) >= n:
                    yield host + path[:n]
            host = host.partition(".")[2]

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each (host, path), or (None, None)."""
        probes, owner = [], []
        for i, (host, path) in enumerate(parts):
            for c in self.candidates(host, path):
                probes.append(c)
                owner.append(i)
        best: list[tuple] = [(-1, -1, None, None)] * len(parts)
        digests = np.fromiter((xxhash.xxh64_intdigest(c.encode()) for c in probes), dtype=np.uint64, count=len(probes))
        first = np.searchsorted(self.keys, digests, side="left")
        for k in np.flatnonzero(first < np.searchsorted(self.keys, digests, side="right")):
            at = int(first[k])
            while at < len(self.keys) and self.keys[at] == digests[k]:
                verdict, _, rule = bytes(self.strings[self.offsets[at] : self.offsets[at + 1]]).decode().partition(" ")
                if rule == probes[k]:
                    best[owner[k]] = max(best[owner[k]], (len(rule), len(_host(rule)), rule, verdict), key=lambda x: x[:2])
                at += 1
        return [(rule, verdict) for _, _, rule, verdict in best]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Judge every row of `pages` (page_id, url): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    prepare(spark)
    uri = scratch(spark, "url-rules") + "/rules.bin"
    write_rules(uri, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with LocalView(uri) as path:
            index = RuleIndex(path)
            for batch in batches:
                parts = [split_url(u) for u in batch.column(1).to_pylist()]
                found = index.judge(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([h for h, _ in parts], pa.string()),
                        pa.array([p for _, p in parts], pa.string()),
                        pa.array([r for r, _ in found], pa.string()),
                        pa.array([v or default for _, v in found], pa.string()),
                    ],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
