import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (id, text) pairs, with extra columns
    whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows],
            DOCS + ", n_words bigint, key string")
    return make
