"""Small tables with the cases that every operator must stand: nulls, ties, repeats, clashing columns, nothing at all."""

import pytest

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

ODD_DOCS = [
    (5, "same text here for all of us", "en", "a"),
    (3, "same text here for all of us", "en", "b"),
    (9, "same text here for all of us", None, "a"),
    (None, "a row without an id", "en", None),
    (7, None, "en", "a"),
    (8, "", None, None),
    (8, "", None, None),
    (4, " \t\n ", "fr", "a"),
    (2, "Ünïcode ☃ text — très long  mot\n\n  fin ", "fr", "a"),
    (1, "word " * 9000, "en", "a"),
    (6, "x" * 30000, "en", "a"),
    (10, "an end <|endoftext|> in the middle<|endoftext|>", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows, and columns whose names the operators use themselves."""
    rows = [(*r, i, "x", 0, 1.5, b"s") for i, r in enumerate(ODD_DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, score double, sha binary").repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="session")
def pieces_model():
    import public_tokenizers

    return public_tokenizers.path(PIECES)
