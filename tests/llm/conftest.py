import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash with results."""

    def make(rows, parts=3):
        full = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)
        return df.selectExpr("*", "'x' as kept", "1.5 as score", "7 as fingerprint", "8 as hash", "9 as size", "'y' as lang_pred")

    return make
