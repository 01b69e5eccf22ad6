"""The operators applied to the test tables: thin queries, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.llm import bpe_codec, embed_dedup, langid, line_dedup, lm_score, media_mpeg, mixing, simhash, token_files, url_filter

#: The folder of the public tokenizers' files, on executors too.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_texts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", with_ids=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return token_files.read_token_files(manifest, with_ids=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dup_64(_table(spark, sf_dir, "documents"), words=3, budget=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.fit(docs, crc_mod("doc_id", 3) != 1)
    out = langid.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score_texts(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dup_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media_mpeg.to_mpeg(_table(spark, sf_dir, "documents"), keep=wanted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_token_files": op3_token_files,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_media": op10_media,
}

_RULES_SQL = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL + "SELECT doc_id, n_lines, n_dropped, CAST(length(t) AS BIGINT) AS kept_chars, md5(t) AS kept_md5 FROM res UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL",
    "op4_url_filter": f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
parts AS (SELECT page_id, translate(CASE WHEN instr(rest, '/') = 0 THEN rest ELSE left(rest, instr(rest, '/') - 1) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN instr(rest, '/') = 0 THEN '' ELSE substr(rest, instr(rest, '/')) END AS path FROM cut),
best AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, max_by(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""",
    "op8_mixing": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  (('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CAST((rnk - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, row_number() OVER o AS place, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own_level
  FROM w WINDOW o AS (ORDER BY cap / weight, rnk), b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS place, arg_min(own_level, place) AS own_level FROM l WHERE cap > weight * own_level),
t AS (SELECT source, source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN cap ELSE weight * f.own_level END AS target FROM l CROSS JOIN f),
q AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
rs AS (SELECT *, target - whole * source_size AS rest FROM q),
fits AS (SELECT d.source, sum(size) FILTER (size <= rest) AS fits FROM d JOIN rs ON d.source IS NOT DISTINCT FROM rs.source GROUP BY d.source),
p AS (SELECT rs.*, CASE WHEN fits >= rest THEN rest ELSE 'inf'::DOUBLE END AS largest FROM rs JOIN fits ON rs.source IS NOT DISTINCT FROM fits.source),
x AS (SELECT *, (size >> greatest(length(bin(size)) - 6, 0)) << greatest(length(bin(size)) - 6, 0) AS x FROM d),
y AS (SELECT x.source, x, rest, CAST(sum(size) AS DOUBLE) AS part FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND rest > 0 AND size <= largest GROUP BY x.source, x, rest),
z AS (SELECT source, x, (rest - coalesce(sum(part) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(x * part) OVER (PARTITION BY source ORDER BY x ROWS UNBOUNDED PRECEDING) AS lam FROM y),
o AS (SELECT source, max(x) AS x_open, arg_max(lam, x) AS lam FROM z WHERE lam * x <= 1 GROUP BY source),
i AS (SELECT x.doc_id, size, u, x, p.*, CASE WHEN x > x_open THEN 1 ELSE lam * x END AS p FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN o ON x.source IS NOT DISTINCT FROM o.source),
k AS (SELECT *, CASE WHEN size > 0 AND rest > 0 AND size <= largest THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS v FROM i),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM k WHERE v IS NOT NULL),
e AS (SELECT source, max(v) AS edge FROM c WHERE before + size / 2.0 <= rest GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * least(whole + CASE WHEN v <= edge THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source""",
}
