"""Rows with every oddity, shared by the tests of this folder."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = "word%d and more of it. "
#: Nulls, empty and blank texts, ties, repeated rows, a very long text and names that clash with inner ones.
TEXTS = [
    (1, "Write to ann.b@mail.example.com or +1 (555) 010-9999 now, please, and then wait for it."), (1, "Write to ann.b@mail.example.com or +1 (555) 010-9999 now, please, and then wait for it."),
    (2, None), (3, ""), (4, " \n\t \n"), (None, "A text without an id, but with words in it and 10.0.0.1 too."), (None, None),
    (5, "".join(LONG % i for i in range(4000))), (6, "Ünïcödé 😀 mail@x.example.org 😀 4111 1111 1111 1111 ß 300.1.1.1 and 9.9.9.9.9"), (7, "x"), (7, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity and with extra columns of clashing names."""
    extra = "spans array<int>, items string, n_words string, row_key string, node int, band int, ids string, masked string, at int, `_gone` int, `_lines` int, text_key long, m int, words int"
    data = [(d, t, "en", "src", 3, [1], "i", "w", "k", 1, 2, "z", "m", 3, 4, 5, 6, 7, 8) for d, t in TEXTS]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
