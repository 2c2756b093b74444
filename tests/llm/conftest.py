import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of the given schema, in a few partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
