import datetime as dt

import pytest

#: Texts with every odd case: null, empty, white space, one word, ties, repeats, other scripts, special tokens, and a long one.
TEXTS = [None, "", " \n\t", "word", "One two", "One two", "a  b\n c\u00a0d  ", "élan Überfluß niño", "日本 語 текст", "<|endoftext|> is text", "x" * 50, "the cat sat on the mat and then the dog " * 800, "The CAT sat on the mat and the dog ran away over the hill to sleep", "the cat sat on the mat and the dog ran away over the hill to sleep", "\x00 nul \x1c sep"]


@pytest.fixture
def odd_docs(spark):
    """Columns in another order and further ones, among them names that operators use inside."""
    rows = [(f"s{i % 3}" if i % 4 else None, t, "en", i, i * 7, "x", 1.5, dt.date(2024, 1, 1)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "source string, text string, lang string, doc_id long, n_chars long, part string, weight double, ids date").repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    import os

    return f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"
