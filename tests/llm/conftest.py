from __future__ import annotations

import pytest

LONG = "word " * 40_000
#: Names of results and of columns inside operators; input columns of these names must not get in the way.
CLASHES = "predicted spans epoch slot lang_pred n_bytes sequence_id offset row key text_key root c0 _row _key".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and then it slept", "en", "a", 1, 0.5, 9),
        (2, "the cat sat on the mat and then it slept", "en", "a", 1, 0.5, 9),
        (2, "the cat sat on the mat and then it slept", "en", "a", 1, 0.5, 9),
        (3, None, None, None, None, None, None),
        (4, "", "fr", "b", 0, 0.1, 1),
        (None, "no id here, only text", "de", "b", 3, 0.2, 2),
        (5, LONG, "en", "a", 7, 0.3, 3),
        (6, "  \n\t ", None, "c", 2, 0.4, 4),
        (7, "ünïcode ß 漢字 <|endoftext|> tail", "de", None, 2, 0.4, 4),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int" + "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *(None if r[0] == 3 else f"own {c}" for c in CLASHES)) for r in rows], names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def long_docs(spark):
    """Texts of megabytes: white space, one letter, words of hex digits, combining marks, one word over and over."""
    texts = [" " * 5_000_000 + "x", "a" * 2_000_000, " ".join(f"{i * 0x9E3779B97F4A7C15 % 2**64:016x}" for i in range(20_000)), "́" * 1_000_000, "word " * 400_000]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashes():
    return CLASHES
