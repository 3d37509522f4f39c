import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A table of documents from texts, or from (doc_id, text) pairs."""

    def build(texts, more=""):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return frame.selectExpr("*", *more) if more else frame

    return build
