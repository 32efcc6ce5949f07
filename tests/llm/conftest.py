import pytest

PROSE = "the quick brown fox jumps over the lazy dog while seven tall ships sail slowly past the quiet harbour wall at dawn"
ODD = [None, "", " \t\n\r\x0b\x0c ", "a", "x" * 70_000, "word " * 9_000, PROSE, PROSE, PROSE + " !", "Ünïcödé 漢字 😀 é", "\x00\x1c\x85\xa0", "line\nline\nline\n\nline"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", f"s{i % 4}" if i % 4 else None, None, "x", "y") for i, t in enumerate(ODD)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, `n.words` string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
