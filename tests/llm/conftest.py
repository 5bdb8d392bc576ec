import pytest

#: Documents every operator must live with: nulls, empty and long texts, repeated
#: rows and ids, and further columns with names the operators use themselves.
EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, node string, value string, "
               "hits string, _text string, kept string, spans string, n_words string, markov string, words string")
LONG = "\n".join(f"long line number {i} of a very long text with words w{i % 97} and w{i % 89}" for i in range(20_000))
EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d"), (6, "a b c d e"), (7, "A B C D E"), (8, LONG), (9, LONG + " tail"),
    (10, "same text of this group with words enough for shingles"), (10, "same text of this group with words enough for shingles"),
    (11, "same text of this group with words enough for shingles"), (None, "a row without an id but with words in it"), (12, "...!!!???"), (13, "日本 語 の 文 章 で す"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(d, t, None if (d or 0) % 2 else "en", None, None, "x", "y", "z", None, "t", None, "s", "w", "m", "q") for d, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
