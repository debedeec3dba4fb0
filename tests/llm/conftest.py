import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def words():
    return WORDS.findall


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are awkward in every way: nulls, empty and blank texts, repeats, ties, a very long text, extra columns."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None, 9, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, " \n\t ", "en", None, 0, "a", "b"), (4, "one two", "en", "s", 0, "a", "b"), (4, "one two", "en", "s", 0, "a", "b"),
        (None, "no id at all", "en", "s", 0, "a", "b"), (5, long_text, "en", "s", 0, "a", "b"), (6, long_text, "de", "s", 0, "a", "b"), (7, "a" * 20_000, "en", "s", 0, "a", "b"), (8, "<|endoftext|> and it's 12 Ünïcode É\u0301 中文 🙂", "en", "s", 0, "a", "b"),
        (9, long_text + " tail", "en", "s", 0, "a", "b"), (10, "same words same words " * 60, "en", "s", 0, "a", "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, h string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
