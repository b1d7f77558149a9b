"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import pytest

CLASH = ["_row", "_text", "_key", "_t", "x0", "x1", "sid", "size", "taken", "copies", "n_words", "contaminated", "toxicity", "quality", "slot", "tokens", "base", "_spans", "key", "n"]
LONG = " ".join(f"word{i % 977} and{i % 61}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(None, "a text without an id", "b"), (1, None, None), (2, "", "a"), (3, "Short one.", "a"), (4, LONG, "a"), (5, LONG, None),
            (6, "x", "z"), (6, "x", "z"), (7, "x", "z"), (8, "é ü 漢字 \x01\x02 a@b.co", "b"), (None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
