"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 code points, words padded with a
blank) in order of frequency. A document's own most frequent n-grams are compared to it: each adds
the difference of the two ranks, or the profile's length where the language lacks it. The smallest
sum names the language; score is 1 less that sum over its largest possible value.

Training counts are taken over the whole texts of at most about SAMPLE labelled documents a language,
drawn by a hash of the id (the documented bound of the fit; all labelled ones where there are fewer).
Every prediction reads the whole text, in blocks, so long texts need bounded memory.

Defined results: `und` with score 0 for a null text, one without a letter, and any text when nothing
was learned. Ties go to the language first in code point order. Repeated rows are judged alike; an
empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetweave.llm.common import materialise, prepare

#: Labelled documents a language that the fit reads, about.
SAMPLE = 2000
#: n-grams in a profile, of a language and of a document.
RANKS = 400
BLOCK = 1 << 20
#: Languages, of some 50 bytes each, up to which their table is broadcast; beyond, it is joined by a shuffle.
FEW_LANGUAGES = 10_000

#: Scores below which a text is in none of the learned languages, of texts of SHORT n-grams or more and of shorter ones. Left-out
#: languages score 0.25 on average against the others' profiles and 0.42 at most, learned ones 0.45 at least (SHORT and more, sf0.01).
LEAST, LEAST_SHORT, SHORT = 0.35, 0.1, 64

_letters = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams packed by 21 bits a code point, ascending; counts). Runs of other than letters are one blank."""
    table, keys, counts, carry = _letter_table(), [], [], ""
    for at in range(0, len(text), BLOCK):
        # Blocks are cut anywhere; the last two code points go on before the next block's.
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(table[codes], codes, 32)
        first = np.frombuffer((carry or " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        joined = np.concatenate([first, codes, [32] if at + BLOCK >= len(text) else []]).astype(np.int64)
        keep = np.ones(len(joined), dtype=bool)
        keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
        joined = joined[keep]
        old = int(keep[: len(first)].sum())
        two = joined[:-1] << 21 | joined[1:]
        three = two[:-1] << 21 | joined[2:]
        one = joined[old:]
        k, c = np.unique(np.concatenate([one[one != 32], two[max(0, old - 1) :], three[max(0, old - 2) :]]), return_counts=True)
        keys.append(k)
        counts.append(c)
        carry = "".join(map(chr, joined[-2:]))
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent keys in order; ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Languages' profiles, ready to be searched: all n-grams sorted, with their rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int):
        self.names, self.ranks = sorted(profiles), ranks
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(profiles[n], np.int64) for n in self.names]]))
        self.table = np.full((len(self.keys) + 1, len(self.names)), -1, dtype=np.int64)
        for j, n in enumerate(self.names):
            self.table[np.searchsorted(self.keys, np.array(profiles[n], np.int64)), j] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """The language, its score, and how many n-grams that rests on."""
        if not text or not self.names:
            return "und", 0.0, 0
        keys, counts = grams(text)
        if not len(keys) or not (keys < 1 << 21).any():
            return "und", 0.0, 0
        own = ranked(keys, counts, self.ranks)
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys))] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        there = self.table[at]
        far = np.where(there < 0, self.ranks, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1.0 - far[best] / (self.ranks * len(own))), len(own)


def fit(docs: DataFrame, trains: F.Column | None = None, sample: int = SAMPLE, ranks: int = RANKS) -> dict[str, list[int]]:
    """Learn profiles from docs (doc_id, text, lang): language -> its n-grams in order.

    trains: condition on doc_id for the rows to learn from. The driver gets `ranks` numbers a language."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    usable = F.col("lang").isNotNull() & (trains if trains is not None else F.lit(True))
    sizes = docs.where(usable).groupBy("lang").agg(F.count("*").alias("n_docs")).withColumnRenamed("lang", "its_lang")
    sizes = materialise(sizes, "lang-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11) / F.lit(float(1 << 53))
    chosen = docs.where(usable).join(sizes, F.col("lang") == F.col("its_lang")).where(u < F.lit(float(sample)) / F.col("n_docs"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[list, list]] = {}

        def flush() -> pa.RecordBatch:
            rows: list[list] = [[], [], []]
            for lang, (ks, cs) in total.items():
                k, back = np.unique(np.concatenate(ks), return_inverse=True)
                rows[0] += [lang] * len(k)
                rows[1].append(k)
                rows[2].append(np.bincount(back, weights=np.concatenate(cs), minlength=len(k)).astype(np.int64))
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *[pa.array(np.concatenate(x), pa.int64()) for x in rows[1:]]], names=["lang", "gram", "n"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k, c = grams(text.as_py() or "")
                ks, cs = total.setdefault(lang, ([], []))
                ks.append(k)
                cs.append(c)
                held += len(k)
                if held > 2_000_000:
                    yield flush()
                    held = 0
        if total:
            yield flush()

    found = chosen.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= ranks)
    out: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "place", "gram").collect()):
        out.setdefault(row[0], []).append(row[2])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, ranks)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def reject_foreign(docs: DataFrame, least: float = LEAST, least_short: float = LEAST_SHORT, short: int = SHORT, sample: int = SAMPLE, ranks: int = RANKS) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, any other columns) in a learned language; a null lang becomes the predicted one.

    A text is kept with a score of `least` or more, one of fewer than `short` different n-grams, which say little, with one of
    `least_short`. Learns from the rows that have a language; that and the id play no part in what is kept."""
    profiles = fit(docs, sample=sample, ranks=ranks)
    at, at_lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, ranks)
        for batch in batches:
            found = [model.judge(t.as_py()) for t in batch.column(at)]
            lang = [own if own is not None else new for own, (new, _, _) in zip(batch.column(at_lang).to_pylist(), found, strict=True)]
            batch = batch.set_column(at_lang, batch.schema.field(at_lang), pa.array(lang, batch.schema.field(at_lang).type))
            yield batch.filter(pa.array([new != "und" and score >= (least if n >= short else least_short) for new, score, n in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
