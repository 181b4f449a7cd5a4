import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) with a column whose name an operator uses itself."""

    def build(texts):
        rows = [(k, t, "x", 5) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_chars bigint")

    return build
