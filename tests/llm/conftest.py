import pytest
from texts import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    long = prose(1, 60_000)
    rows = [
        (1, "Some words that are plain, and a few more of them here.", "en", 3),
        (1, "Some words that are plain, and a few more of them here.", "en", 3),
        (2, None, None, None),
        (3, "", "en", 0),
        (None, "A text without an id.", None, None),
        (None, "A text without an id.", "de", 1),
        (4, long, "en", 1),
        (5, "x" * 200_000, "en", 1),
        (6, "  \n\t  ", "fr", 1),
        (7, "ünïcode ßtrings – 漢字 and \U0001f600 emoji", "de", 1),
        (8, "!!! *** ???", "en", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, key int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
