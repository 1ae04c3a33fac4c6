import pytest

LONG = "lorem ipsum " * 60_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and other columns whose names operators use themselves."""
    rows = [
        (None, None, None, None), (None, "a lone text without an id", "en", "s0"), (1, "", "en", "s0"), (2, None, None, None),
        (3, "one two", "en", "s1"), (3, "one two", "en", "s1"), (4, LONG, "en", None), (5, "12 34 !!", "de", "s1"),
        (6, "Released under the MIT License. All rights reserved.", "en", "s0"), (7, "One  TWO", "fr", "s2"),
        (8, "the quick brown fox jumps over the lazy dog and runs away", "en", "s2"),
        (9, "The quick brown fox jumps over the lazy dog and runs away", "en", "s2"), (10, "é ñ ü 中文 <|endoftext|> \u00a0 x\n\n y", "es", "s1"),
    ]
    clash = "size long, target double, copies long, piece int, ids string, cid long, sig long, words string, rank int, n long, p string, host string, `row` int"
    extra = (1, 2.0, 3, 4, "ids", 5, 6, "words", 7, 8, "p", "host", 9)
    return spark.createDataFrame([r + extra for r in rows], "doc_id long, text string, lang string, source string, " + clash)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def repeats():
    """Two words of 1,024 letters, each half the other's with its letters exchanged: any polynomial modulo a power of two takes them for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
