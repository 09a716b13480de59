from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names operators use inside."""

    def make(rows, source="s"):
        full = [(d, t, "en", source, len(t or ""), "x", 7, "y") for d, t in rows]
        schema = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, n bigint, digest string"
        )
        return spark.createDataFrame(full, schema)

    return make


ODD_TEXTS = [
    (0, None),
    (1, ""),
    (2, " \n\t \n"),
    (3, "one"),
    (4, "one two"),
    (5, "One Two three four five six seven eight nine ten."),
    (6, "one two three four five six seven eight nine ten."),
    (7, "ünï\x85cödé\xa0 words \x1c stay   日本語 テキスト 🎉 whole"),
    (8, "same line of six words here\n" * 40),
    (9, "a" * 70_000),
    (10, "word " * 30_000),
    (None, "a row without a key but with ten words in its text."),
    (12, None),
]
