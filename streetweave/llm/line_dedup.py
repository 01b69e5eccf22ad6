"""Line dedup by a fixed-depth tree of line templates, in DataFrame functions only.

A line's tokens are its words; a token with a digit is a variable field, `<*>`. The tree has a level for
the number of tokens and one for each of the first LEAD tokens; a leaf holds the lines that agree in
these. In a leaf, a token that fewer than `min_docs` lines have at its place is a variable field as well,
as long as at least half of the line's tokens behind the leading ones stay constant; the line with its
variable fields is its template.

A template recurs across documents if it occurs in at least `min_docs` documents that aren't copies of
one another. Documents with the same masked lines are copies. So are those of which four fifths (by bytes
of masked lines) are templates that occur first, by document id, in one and the same document. Licence
texts, headers and passages of any number of lines that documents share are found, while whole documents
that were copied a few or a thousand times are left for the stages that compare whole documents. The
document with the smallest id keeps a recurring template's lines; all others lose them.

Only leaves with `min_docs` lines or more go on after the first count: a bit set, sized by their number,
drops most other lines where they are read, and a join the rest. Hashes, ids, positions and those leaves' lines are
shuffled; copies fall together before their templates are counted; the texts move once, to meet the positions
of the lines that they lose. The work is linear in a document's lines.

Defined results: a null text stays null and has no lines; empty lines are kept and never counted. Rows of
one id keep and lose lines as one document, but texts that differ count each for themselves; null ids are a
document that keeps no recurring template which an id has too. An empty table gives an empty result. A text of
very many lines costs in proportion. Columns of `docs` come through unchanged but for `text`, whatever their
names. Lines and documents are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetweave.llm.common import fresh, materialise

LEAD = 3
MIN_DOCS = 3
FIELD = "<*>"
COUNTS = ("n_lines", "n_dropped")
#: Parts of five of a document that must come from one other for the two to be copies.
FIFTHS = 4
#: Bits for a crowded leaf in the bit set, and the most bits of it: 32 MB.
BITS_A_LEAF, MOST_BITS = 16, 1 << 28


def _mask(line: Column) -> Column:
    tokens = F.transform(F.split(line, " "), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.when(line.rlike("[0-9]"), F.array_join(tokens, " ")).otherwise(line)


def masked_lines(text: Column) -> Column:
    """The lines with single blanks between tokens and `<*>` for tokens with a digit."""
    # Only what isn't a single blank is replaced, which few places are.
    flat = F.regexp_replace(text, "[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), _mask)


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    """A row for each line that isn't empty: document, row, position, hash, leaf, bytes, the document's bytes and hash, and the line."""
    d = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("ld_doc"), F.xxhash64("text").alias("ld_row"), masked_lines(F.col("text")).alias("ld_norms"))
    # The document's figures come before its rows are made, once for each. The outer form has the same rows, and spares the
    # filters on the array that the optimizer would add, which work out all lines again.
    d = d.withColumn("ld_total", F.octet_length(F.array_join("ld_norms", "")).cast("long")).withColumn("ld_copy", F.xxhash64("ld_norms"))
    d = d.select("ld_doc", "ld_row", "ld_total", "ld_copy", F.posexplode_outer("ld_norms").alias("ld_at", "ld_norm"))
    tokens = F.octet_length("ld_norm") - F.octet_length(F.replace(F.col("ld_norm"), F.lit(" "), F.lit(""))) + 1
    return d.where(F.col("ld_norm") != "").select(
        "ld_doc",
        "ld_row",
        "ld_at",
        F.xxhash64("ld_norm").alias("ld_h"),
        F.xxhash64(tokens, F.substring_index("ld_norm", " ", lead)).alias("ld_leaf"),
        F.octet_length("ld_norm").cast("long").alias("ld_len"),
        "ld_total",
        "ld_copy",
        "ld_norm",
    )


def _templates(lines: DataFrame, lead: int, min_docs: int) -> DataFrame:
    """(ld_h, ld_template) of the lines in crowded leaves."""
    norms = lines.groupBy("ld_leaf", "ld_h").agg(F.min("ld_norm").alias("ld_norm"), F.count("*").alias("n"))
    tokens = norms.select("ld_leaf", "ld_h", "n", F.posexplode(F.split("ld_norm", " ")).alias("p", "token"))
    seen = tokens.where(F.col("p") >= lead).groupBy("ld_leaf", "p", "token").agg(F.sum("n").alias("support"))
    seen = seen.where((F.col("support") >= min_docs) & (F.col("token") != FIELD)).select(F.col("ld_leaf").alias("l"), F.col("p").alias("q"), F.col("token").alias("t"))
    marked = tokens.join(seen, (F.col("ld_leaf") == F.col("l")) & (F.col("p") == F.col("q")) & (F.col("token") == F.col("t")), "left")
    constant = F.col("l").isNotNull() | ((F.col("p") < lead) & (F.col("token") != FIELD))
    general = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.when(constant, F.col("token")).otherwise(F.lit(FIELD)).alias("field")))), lambda x: x["field"]), " ")
    made = marked.groupBy("ld_leaf", "ld_h").agg(general.alias("general"), F.avg(F.when(F.col("p") >= lead, constant.cast("double"))).alias("share"))
    made = made.withColumn("template", F.when(F.col("share") >= 0.5, F.xxhash64("general")).otherwise(F.col("ld_h")))
    return made.select("ld_h", F.xxhash64("ld_leaf", "template").alias("ld_template"))


def _maybe(leaves: DataFrame) -> Column:
    """False only for lines whose leaf isn't in `leaves`: a bit set that some leaves share, as one scalar of bounded size."""
    n = leaves.count()
    if n * 2 > MOST_BITS:
        return F.lit(True)  # too full to tell; the join does
    slots = min(MOST_BITS, max(1 << 16, 1 << (n * BITS_A_LEAF).bit_length()))
    slot = F.pmod(F.col("ld_leaf"), F.lit(slots))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    words = leaves.groupBy(word.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    every = leaves.sparkSession.range(slots // 64).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
    filled = F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bits = every.agg(F.transform(filled, lambda x: x["bits"]).alias("bits"))
    return F.getbit(F.get(bits.scalar(), word), bit) == 1


def _recurring(placed: DataFrame, min_docs: int) -> DataFrame:
    """(ld_template, ld_first) of the templates in `min_docs` documents that aren't copies of one another."""
    firsts = placed.groupBy("ld_template").agg(F.min("ld_doc").alias("ld_first"), F.countDistinct("ld_copy").alias("n"))
    firsts = materialise(firsts, "line-firsts")
    # Documents of the same masked lines are one shape from here on.
    shapes = placed.groupBy("ld_copy", "ld_at").agg(F.min("ld_template").alias("ld_template"), F.min("ld_len").alias("len"), F.min("ld_total").alias("total"))
    shapes = materialise(shapes.join(firsts, "ld_template"), "line-shapes")
    most = shapes.groupBy("ld_copy", "ld_first").agg(F.sum("len").alias("part"), F.min("total").alias("total")).where(F.col("part") * 5 >= F.col("total") * FIFTHS)
    of = most.select("ld_copy", F.xxhash64(F.lit("copies of"), "ld_first").alias("source"))
    classes = shapes.where(F.col("n") >= min_docs).select("ld_template", "ld_first", "ld_copy").join(of, "ld_copy", "left")
    found = classes.groupBy("ld_template", "ld_first").agg(F.countDistinct(F.coalesce("source", "ld_copy")).alias("n"))
    return found.where(F.col("n") >= min_docs).select("ld_template", "ld_first")


def lines_to_drop(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD) -> DataFrame:
    """(ld_doc, ld_row, ld_drop): for each text that loses lines, told by its id and hash, the positions of those."""
    lines = _lines(docs, lead)
    crowded = materialise(lines.groupBy("ld_leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("ld_leaf"), "line-leaves")
    # Most lines go by the bits of crowded leaves, before the join, so their text isn't shuffled.
    lines = materialise(lines.where(_maybe(crowded)).join(crowded, "ld_leaf", "left_semi"), "line-lines")
    templates = materialise(_templates(lines, lead, min_docs), "line-templates")
    placed = materialise(lines.drop("ld_norm", "ld_leaf").join(templates, "ld_h").drop("ld_h"), "line-placed")
    recurring = materialise(_recurring(placed, min_docs), "line-recurring")
    lost = placed.join(recurring, "ld_template").where(~F.col("ld_doc").eqNullSafe(F.col("ld_first")))
    return lost.groupBy("ld_doc", "ld_row").agg(F.collect_set("ld_at").alias("ld_drop"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, counts: bool = False) -> DataFrame:
    """`docs` (doc_id, text, any other columns) without the lines of recurring templates.

    counts: adds n_lines and n_dropped, in place of columns of those names."""
    who, row, drop = (fresh(docs, x) for x in ("ld_doc", "ld_row", "ld_drop"))
    lost = lines_to_drop(docs, min_docs, lead).select(F.col("ld_doc").alias(who), F.col("ld_row").alias(row), F.col("ld_drop").alias(drop))
    d = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(who)) & (F.xxhash64("text") == F.col(row)), "left")
    split = F.split("text", "\n")
    # The lines are an element of an array, so that the inner function finds them ready and doesn't split the text for each.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text")
    columns = [text if c == "text" else F.col(c) for c in docs.columns if not (counts and c in COUNTS)]
    if counts:
        n = F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0)).cast("long")
        lost_lines = F.coalesce(F.when(F.col(drop).isNotNull(), F.size(drop)), F.lit(0)).cast("long")
        columns += [n.alias(COUNTS[0]), lost_lines.alias(COUNTS[1])]
    return d.select(*columns)


ORACLE_SQL = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ex AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw),
fl AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')) AS flat FROM ex),
nm AS (SELECT doc_id, pos, line, list_transform(string_split(flat, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS toks FROM fl),
l0 AS (SELECT doc_id, pos, line, toks, array_to_string(toks, ' ') AS norm, len(toks) || ' ' || array_to_string(toks[1:{LEAD}], ' ') AS leaf FROM nm),
whole AS (SELECT doc_id, sum(strlen(norm)) AS total, md5(string_agg(norm, chr(10) ORDER BY pos)) AS copy FROM l0 GROUP BY doc_id),
crowded AS (SELECT leaf FROM l0 WHERE norm <> '' GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
l2 AS (SELECT * FROM l0 WHERE norm <> '' AND leaf IN (SELECT leaf FROM crowded)),
norms AS (SELECT leaf, norm, any_value(toks) AS toks, count(*) AS n FROM l2 GROUP BY leaf, norm),
tk AS (SELECT leaf, norm, n, unnest(toks) AS token, unnest(range(len(toks))) AS p FROM norms),
seen AS (SELECT leaf, p, token FROM tk WHERE p >= {LEAD} AND token <> '{FIELD}' GROUP BY leaf, p, token HAVING sum(n) >= {MIN_DOCS}),
mk AS (SELECT tk.*, seen.leaf IS NOT NULL OR (tk.p < {LEAD} AND tk.token <> '{FIELD}') AS keep FROM tk LEFT JOIN seen ON tk.leaf = seen.leaf AND tk.p = seen.p AND tk.token = seen.token),
tp AS (SELECT leaf, norm, CASE WHEN avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END) FILTER (p >= {LEAD}) >= 0.5 THEN 'G ' || string_agg(CASE WHEN keep THEN token ELSE '{FIELD}' END, ' ' ORDER BY p) ELSE 'N ' || norm END AS template FROM mk GROUP BY leaf, norm),
pl AS (SELECT l2.doc_id, l2.pos, strlen(l2.norm) AS bytes, tp.leaf || ' ' || tp.template AS template FROM l2 JOIN tp ON l2.leaf = tp.leaf AND l2.norm = tp.norm),
firsts AS (SELECT template, min(doc_id) AS first_doc FROM pl GROUP BY template),
parts AS (SELECT pl.doc_id, first_doc, sum(bytes) AS part FROM pl JOIN firsts ON pl.template = firsts.template GROUP BY pl.doc_id, first_doc),
classes AS (SELECT whole.doc_id, coalesce('of ' || first_doc, copy) AS class FROM whole LEFT JOIN parts ON whole.doc_id = parts.doc_id AND part * 5 >= total * {FIFTHS}),
rec AS (SELECT template, min(pl.doc_id) AS first_doc FROM pl JOIN classes ON pl.doc_id = classes.doc_id GROUP BY template HAVING count(DISTINCT class) >= {MIN_DOCS}),
lost AS (SELECT pl.doc_id, pl.pos FROM pl JOIN rec ON pl.template = rec.template WHERE pl.doc_id <> first_doc),
kept AS (SELECT l0.doc_id, l0.pos, l0.line, lost.pos IS NULL AS k FROM l0 LEFT JOIN lost ON l0.doc_id = lost.doc_id AND l0.pos = lost.pos),
res AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k), '') AS t FROM kept GROUP BY doc_id)
"""
