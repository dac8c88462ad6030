import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """(doc_id, text[, lang]) rows to a documents table, with extra columns that clash with the operators' own names."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F
            for c in ("row_key", "score", "kind", "start", "length", "rank", "value", "key", "n", "spans", "cell", "bound", "salt"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make


SF = "/root/testdata/sf0.001"
