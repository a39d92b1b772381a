from __future__ import annotations

import pytest

from cohortkit.llm.queries import reachable


@pytest.fixture(autouse=True)
def workers(spark):
    reachable(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null and repeated doc_ids, an extra column."""
    words = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "one", "en", "s", 3, 1),
        (3, "one", "en", "s", 3, 1), (None, "one two three four five", "en", "s", 20, 1),
        (None, "one two three four five", "en", "s", 20, 2), (5, words, "en", "s", len(words), 1),
        (6, "é  x ퟿ \U0001f600 \x00\t\n end ", "fr", None, 9, None), (7, " ", None, "s", 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
