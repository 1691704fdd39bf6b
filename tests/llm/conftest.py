import pytest

pytest.importorskip("ledgerlight.llm")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with outputs."""

    def make(rows, extra=True):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            frame = frame.selectExpr("*", "'x' AS size", "1 AS score", "'y' AS fingerprint", "0 AS n_hit", "2 AS block", "'en' AS lang")
        return frame

    return make
