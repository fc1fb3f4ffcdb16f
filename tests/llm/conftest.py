from __future__ import annotations

import pytest
from texts import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHES = ("group", "fp", "key", "n", "wanted", "known", "file", "part", "bin", "words", "_id", "start", "score", "host", "rank", "b", "d2")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build documents from `(doc_id, text)` or `(doc_id, text, lang, source)` rows, with extra clashing columns."""

    def build(rows):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], *(r[2:] or ("en", "s1")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit("extra") for c in CLASHES})

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and white texts, one very long text, repeated rows and ties."""
    return [
        (None, words(1, 80)), (1, None), (2, ""), (3, " \n\t  "), (4, words(2, 60_000)), (5, words(3, 70)), (5, words(3, 70)),
        (6, words(3, 70), None, None), (7, words(4, 90), "en", None), (8, "ein"), (9, "Zwei Wörter, ÉTÉ <|endoftext|> 'S \x1c..,"),
    ]


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([(1, "x")]).where("false")
