import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) with an extra column whose name clashes with an output."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("*", "'x' AS n_words", "1 AS score", "array(1) AS ids") if extra else df

    return make
