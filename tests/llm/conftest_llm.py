import os
import random

import pytest

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Names that operators use inside or return, as extra columns of the input.
EXTRA = "n_tokens long, score double, size long, copies long, node long, u double, slot int, ld_doc long, its_doc long, keep_text string, lang_pred string, h long, component_id long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
N_EXTRA = len(EXTRA.split(", "))


def words(rng, n, syllables=("the", "an", "er", "on", "re", "he", "in", "ed")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def make(spark, rows):
    """rows: (doc_id, text, lang, source), with other columns added."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * N_EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a long text, an unsplit one, ties and repeated rows."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    return [
        (0, None, "en", "a"),
        (1, "", "en", None),
        (2, " \t\n ", None, "a"),
        (3, long, "en", "a"),
        (4, "x" * 30_000, "en", "b"),
        (5, "1234 !! ...", "en", "b"),
        (6, words(rng, 50), "en", "a"),
        (6, words(random.Random(9), 50), "en", "a"),
        (7, words(random.Random(9), 50), "en", "a"),
        (8, "été à la maison", "fr", "b"),
        (8, "été à la maison", "fr", "b"),
        (None, words(rng, 20), None, None),
        (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return make(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
