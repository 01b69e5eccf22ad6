"""A corpus pipeline of five stages: language ID, line dedup, SimHash near-dedup, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir) that works on all rows of `docs`, which are what the stage
before it kept. All but the last return the columns of documents.

Defined results, as the operators': null, empty and blank texts are in no language and go in the first stage, so later ones don't meet
them in `run`, but take them as well (lines: kept as they are; near copies: texts without words are copies of one another; mixing: size 0,
whole copies only; BPE: no tokens). Rows of one id are one document to line dedup and near-dedup; rows of a null id are never
dropped as copies. Ties go to the smallest id. Very long texts are worked on whole. Empty tables give empty results. Other
columns pass through, whatever their names, up to BPE, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm import bpe_codec, langid, line_dedup, mixing, simhash
from streetweave.llm.common import discard, materialise, prepare
from streetweave.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or like none of them, go. A null lang becomes the predicted one."""
    return langid.reject_foreign(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; n_chars follows the text."""
    out = line_dedup.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest id."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs, weights=(1, 2, 3))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, with digests of the ids and of the text decoded from them."""
    return bpe_codec.encode_texts(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage's model cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the stage's input, unless it is the table of documents itself
    return STAGES[-1][1](spark, docs, sf_dir)
