import pytest
from texts import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with extra columns whose names clash with results, a null doc_id, a null language and a repeated row."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), 1.0, 7, "k") for i, t in enumerate(ODD)]
    rows += [(None, "null id text here with words", "fr", None, 28, 1.0, 7, "k"), rows[4], rows[13]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
