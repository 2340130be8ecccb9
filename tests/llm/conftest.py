import pytest
from corpus_rows import SCHEMA, TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*x, len(x[1] or ""), 0, "d", 1, 2, 0.5, 9) for x in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
