import pytest
from odd_rows import ODD_TEXTS
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, a repeated row, a null id, ties, long texts, and a column that looks like a result."""
    rows = [(i, t, None, "s", None, "clash") for i, t in enumerate(ODD_TEXTS)]
    rows += [(4, "Same text here.", "en", None, 1, None), (None, "no id", None, None, None, None)]
    kinds = [("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()),
             ("n_chars", LongType()), ("score", StringType())]
    return spark.createDataFrame(rows, StructType([StructField(n, t) for n, t in kinds])).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
