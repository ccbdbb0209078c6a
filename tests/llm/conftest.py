"""Documents with all awkward cases at once, as the operators' tests use them."""

from __future__ import annotations

import pytest

AWKWARD = [
    (1, "One two three four five six seven eight nine ten."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "One two three four five six seven eight nine ten."),
    (5, "One two three four five six seven eight nine ten."),
    (6, "one"),
    (7, "naïve 日本語 🙂 ▁ text\r\nwith \x0b odd \x00 characters \\ [x] $1"),
    (8, "x" * 70_000),
    (9, "word " * 40_000),
    (10, "1234 5678 !!! ???"),
    (None, "One two three four five six seven eight nine ten."),
    (None, None),
]


@pytest.fixture
def awkward(spark):
    """doc_id, text, and columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "own", 1.5) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, run int, fp string, score double").repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
