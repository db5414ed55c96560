import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size string, bucket string, component string, chunk string"


@pytest.fixture
def docs(spark):
    """Rows as documents, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, src, len(t or ""), -1, "x", "y", "z", "c", "k") for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd():
    """Null, empty, blank, wordless, long and repeated texts, null columns."""
    rng = random.Random(7)
    words = ["the", "café", "of", "token", "ab12", "x@y.zz", "ñandú", "—", "　", "1.2.3.4", "😀"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, "12 34 !?", "fr", "b"), (5, long, "en", "a"), (6, long, "en", "a"), (6, long, "en", "a"), (None, "a null id stays here", "en", "a"), (7, "a null id stays here", "fr", None), (8, "word", "en", "é"), (9, "two words", "en", "z")]
