import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table; extra columns have names that the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node int, sig string").repartition(3)

    return make
