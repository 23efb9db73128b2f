import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text, lang, source) rows."""
    def make(rows, extra=""):
        rows = [(*r[:4], len(r[1] or ""), *r[4:]) for r in rows]
        return spark.createDataFrame(rows, DOCUMENTS + extra)

    return make


def words_of(text):
    return (text or "").encode().lower().split()
