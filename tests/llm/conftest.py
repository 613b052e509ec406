import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, bucket string, shard string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977}x" for i in range(40_000))
    line = "the quick brown fox jumps over the lazy dog and then it sleeps again for a very long while\n"
    rows = [
        (1, line * 5, "en", "a", 1, "x", "y", "z"),
        (2, line * 5, "en", "a", 1, "x", "y", "z"),
        (3, "", "en", None, 0, None, None, None),
        (4, None, None, "b", None, None, None, None),
        (None, "only a few words here and nothing else", "en", "b", 1, None, None, None),
        (5, long, "en", "a", len(long), None, None, None),
        (6, long + " tail", "en", "a", len(long), None, None, None),
        (7, "één tekst met ünïcode 🎉 <|endoftext|> en meer \x00 tekens", "nl", "c", 1, None, None, None),
        (7, "één tekst met ünïcode 🎉 <|endoftext|> en meer \x00 tekens", "nl", "c", 1, None, None, None),
        (8, "   \n\t ", None, "c", 6, None, None, None),
        (9, "a b", "en", "", 3, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
