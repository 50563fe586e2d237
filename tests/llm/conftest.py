import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows that are odd in every way, and copies."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [
        (5, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (7, "start " + base + " end", "en", "a", 1),
        (8, None, None, None, None),
        (9, "", "en", "b", 0),
        (10, " \t\n\x0b ", "en", "b", 0),
        (11, "one", "en", "b", 3),
        (12, "x " * 300, "en", "b", 600),
        (None, base, "en", "a", 1),
        (13, "Ünï ́x  y　z <|endoftext|> it's 'S ΣΑΣᾳ \x1c q\x0bx 日本語。 Ǆ, İ. ﬁ; …. 12.5", "en", "c", 1),
        (14, "long" * 20_000, "en", "c", 80_000),
        (15, ("a b c d e f g\n" * 3) + "\n\nZ", "en", "c", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
