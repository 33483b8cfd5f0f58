import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, slot long, kept int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) with extra columns whose names operators use inside."""

    def run(rows):
        full = [(*r, *[None] * (4 - len(r)), 7, "x", 1, 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)

    return run


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows and one very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, "The quick  brown\tfox", "en", "a"), (2, "The quick brown fox", "en", "a"), (2, "The quick brown fox", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, "   \n", "de", "b"), (None, "no id here at all", "de", None),
        (6, long, "en", "c"), (7, long, "en", "c"), (8, "über die Brücke gehen\x1cwir", "de", "a"), (9, "!!! ***", "en", "a"),
    ]
